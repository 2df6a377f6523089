"""Event intake, throttling and upserts with Structured Streaming."""
