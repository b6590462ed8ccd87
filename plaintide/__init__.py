"""Demand analytics on Spark."""
