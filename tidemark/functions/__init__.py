"""Column expressions, running scans and exact statistics."""
