"""Readers, writers and views of the driver's tables."""
