"""Readers with validation, and writers with upsert and retention rules."""
