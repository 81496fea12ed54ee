"""From an ontology to a schema: plan, columns, reconciliation, table definitions and seed rows."""
