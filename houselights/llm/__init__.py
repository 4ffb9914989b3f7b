"""Operators for preparing text corpora: quality, deduplication, decontamination, mixing, sharding and scans."""
