"""Readers for landed responses and the versioned index."""
