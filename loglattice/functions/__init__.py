"""Column-level building blocks: field resolution, time buckets, text redaction, JSON leaves."""
