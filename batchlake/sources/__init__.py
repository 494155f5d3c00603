"""Readers, caches and file helpers."""
