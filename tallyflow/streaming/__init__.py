"""Structured Streaming sources and stateful views of records."""
