"""Readers, writers and adapters to the record schemas."""
