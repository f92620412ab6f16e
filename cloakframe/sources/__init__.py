"""Adapters for JSON, message records, database errors and log events."""
