"""Structured Streaming extension: digests of newly arriving files."""
