"""Training-data operators: quality, language, near copies, leaks, mixing, formatting, licences, shards."""
