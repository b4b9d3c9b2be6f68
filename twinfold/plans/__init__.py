"""The duplicate store and the reports over it."""
