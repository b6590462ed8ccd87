"""Readers and writers of messages, pools, ledgers and text trees."""
