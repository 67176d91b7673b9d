"""Logs as streams: exactly-once delivery, limits, live queries, publishing and presence with Structured Streaming."""
