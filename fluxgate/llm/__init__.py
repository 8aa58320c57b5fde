"""Training-data operators: URL verdicts, sharding, search, PII, packing,
deduplication, quality, and mixing.  Nothing outside this folder imports it."""
