"""Training-data operators: scans, deduplication, decontamination, scoring, sharding and packing.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
