"""Training-data operators: quality, dedup, language ID, extraction, mixing, packing, token files.

Nothing outside this subpackage imports it; ``registry`` lists its queries.
"""
