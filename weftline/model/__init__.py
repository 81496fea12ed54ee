"""Ontology, names and the mapping to tables: driver-side metadata, never DataFrames."""
