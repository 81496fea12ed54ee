"""Relational building blocks that plans are made of: scans, predicates, joins, aggregates, order."""
