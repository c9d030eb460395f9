"""Readers, writers and durable intermediate tables."""
