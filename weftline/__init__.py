"""Ontology-driven structured operations on Spark DataFrames."""
