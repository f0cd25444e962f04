"""SQL twins of the registered queries, for a side-by-side check in another engine."""
