"""Adapters from the test tables and the registered queries."""
