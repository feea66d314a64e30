"""Readers, feed mappings and snapshot writers."""
