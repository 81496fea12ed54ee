"""Where tables come from and go to: read-only catalogs, the versioned store, constraints, INSERT text."""
