"""Operators for preparing training text: scoring, extraction, deduplication, formatting, mixing and packing."""
