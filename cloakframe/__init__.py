"""Spark-first detection and masking of personal data."""
