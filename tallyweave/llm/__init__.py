"""Operators for large text corpora: filtering, deduplication, decontamination, packing."""
