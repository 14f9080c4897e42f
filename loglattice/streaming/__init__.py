"""Structured Streaming versions of reading, counting, tagging, correlating and deduplicating logs."""
