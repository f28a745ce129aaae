"""Operators for preparing training corpora: deduplication, filtering, scoring, extraction and packing."""
