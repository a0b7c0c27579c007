"""Training-data operators: dedup, tokenising, quality, toxicity, language, search, mixing, scoring.

Nothing outside this subpackage imports it.
"""
