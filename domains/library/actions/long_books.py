"""How many books count as two: those of more than ``pages`` pages."""

DEFINITION = {"name": "long_books", "description": "Count books of more than the given pages.", "params": {"pages": {"type": "integer"}}}


def execute(params, context, mapping):
    return context.table(mapping.table("Book").name).where(f"pages > {int(params.get('pages', 600))}").count()
