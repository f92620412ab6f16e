"""DataFrame-to-DataFrame operators: masking, text scanning, vault, reports."""
