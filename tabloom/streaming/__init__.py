"""Structured Streaming jobs: event intake, outlier guard, deduplication, live scoring."""
