"""Event-stream operators, as batch jobs and as Structured Streaming jobs."""
