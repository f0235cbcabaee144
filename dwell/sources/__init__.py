"""Readers, writers and the stored usage tables."""
