"""Training-data operators: quality, token files, licences, packing, dedup, search, scoring."""
