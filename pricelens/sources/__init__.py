"""Readers and writers: listings CSV (with repair and quarantine), artifacts, test tables."""
