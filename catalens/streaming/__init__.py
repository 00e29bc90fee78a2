"""Structured Streaming forms of the request and metadata operators."""
