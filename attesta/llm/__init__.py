"""Training-data operators: dedup, quality, secrets, packing, tokenising, media and web archives.

Nothing outside this subpackage imports it.
"""
