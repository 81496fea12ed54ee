"""Names of tables and columns derived from ontology names."""

from __future__ import annotations


def local_name(iri: str) -> str:
    return iri.rpartition("#")[2].rpartition("/")[2]


def snake(name: str) -> str:
    """An underscore before every capital but the first character, then lower case."""
    return "".join(f"_{c}" if c.isupper() and i else c for i, c in enumerate(name)).lower()


def plural(name: str) -> str:
    if name.endswith("s"):
        return name
    return f"{name[:-1]}ies" if name.endswith("y") else f"{name}s"


def prefixed(prefix: str, name: str) -> str:
    return f"{prefix}_{name}" if prefix else name


def table_name(prefix: str, cls: str) -> str:
    return prefixed(prefix, plural(snake(cls)))


def key_name(prefix: str, cls: str) -> str:
    return prefixed(prefix, f"{snake(cls)}_id")
