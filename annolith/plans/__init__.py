"""Whole jobs: building a paired dataset, auditing it, scoring predictions."""
