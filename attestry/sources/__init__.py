"""Readers of records and documents, and idempotent loads into stored tables."""
