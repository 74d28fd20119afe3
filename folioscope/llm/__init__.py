"""Operators for preparing training text: mixing, deduplication, decontamination, scans, archives, shards."""
