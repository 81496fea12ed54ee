"""From operations to DataFrame plans: parsing, validation, tool schema, compilation and rewrites."""
