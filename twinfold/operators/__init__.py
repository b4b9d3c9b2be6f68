"""Scan, verification, maintenance and hash-cache operators."""
