"""Named analyses and the registry of queries."""
