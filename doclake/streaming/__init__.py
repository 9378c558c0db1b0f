"""The ingestion plan on Structured Streaming."""
