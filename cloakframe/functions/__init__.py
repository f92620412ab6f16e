"""Column functions: maskers, checksums, gates, keyed pseudonyms."""
