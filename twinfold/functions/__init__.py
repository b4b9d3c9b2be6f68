"""Column functions: digests, paths, rendering."""
