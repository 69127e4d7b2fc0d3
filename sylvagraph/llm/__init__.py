"""Training-data operators: tokenising, deduplication, decontamination, filtering, scoring, formatting.

Nothing outside this subpackage imports it.
"""
