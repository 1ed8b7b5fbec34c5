"""Readers and writers; only these modules touch paths."""
