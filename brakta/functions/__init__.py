"""Column-level functions: text, checksums, parsing."""
