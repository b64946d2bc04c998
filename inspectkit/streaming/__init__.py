"""Structured Streaming jobs over arriving quality records."""
