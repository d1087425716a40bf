"""Column-level helpers: they take and return columns."""
