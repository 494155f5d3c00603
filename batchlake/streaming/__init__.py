"""Batches from streams."""
