"""Readers, writers and their checks."""
