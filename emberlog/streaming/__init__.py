"""Live following of logs by Structured Streaming."""
