"""The pre-filter and the deduplicator as Structured Streaming jobs."""
