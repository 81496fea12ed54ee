"""Operations as records.  Parsing never fails: a part of the wrong kind is left out."""

from __future__ import annotations

from dataclasses import dataclass, field

OPS = ("query", "create", "update", "delete", "link", "unlink", "action")
AGGREGATES = ("count", "sum", "avg", "min", "max")
DIRECTIONS = ("asc", "desc")


@dataclass(frozen=True)
class Hop:
    rel: str
    entity: str
    filters: dict = field(default_factory=dict)


@dataclass(frozen=True)
class End:
    entity: str
    filters: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Query:
    entity: str
    fields: tuple[str, ...] = ()
    filters: dict = field(default_factory=dict)
    relations: tuple[Hop, ...] = ()
    aggregate: tuple[str, str | None] | None = None
    sort: tuple[str, str] | None = None
    limit: int = 0
    op: str = "query"


@dataclass(frozen=True)
class Create:
    entity: str
    data: dict = field(default_factory=dict)
    resolve: dict[str, End] = field(default_factory=dict)
    op: str = "create"


@dataclass(frozen=True)
class Update:
    entity: str
    data: dict = field(default_factory=dict)
    filters: dict = field(default_factory=dict)
    op: str = "update"


@dataclass(frozen=True)
class Delete:
    entity: str
    filters: dict = field(default_factory=dict)
    op: str = "delete"


@dataclass(frozen=True)
class Link:
    relation: str
    start: End
    end: End
    op: str = "link"


@dataclass(frozen=True)
class Call:
    action: str
    params: dict = field(default_factory=dict)
    op: str = "action"


def _dict(x) -> dict:
    return x if isinstance(x, dict) else {}


def _text(x) -> str:
    return x if isinstance(x, str) else ""


def _end(x) -> End:
    x = _dict(x)
    return End(_text(x.get("entity")), _dict(x.get("filters")))


def parse(raw: dict):
    """The record of a raw operation, None where ``op`` is unknown."""
    raw = _dict(raw)
    op, entity, filters, data = raw.get("op"), _text(raw.get("entity")), _dict(raw.get("filters")), _dict(raw.get("data"))
    if op == "query":
        aggregate, sort, limit = _dict(raw.get("aggregate")), _dict(raw.get("sort")), raw.get("limit")
        hops = raw.get("relations") if isinstance(raw.get("relations"), list) else []
        fields = raw.get("fields") if isinstance(raw.get("fields"), list) else []
        return Query(
            entity,
            tuple(f for f in fields if isinstance(f, str)),
            filters,
            tuple(Hop(_text(h.get("rel")), _text(h.get("entity")), _dict(h.get("filters"))) for h in hops if isinstance(h, dict)),
            (_text(aggregate.get("fn")), aggregate.get("field") or None) if aggregate else None,
            (_text(sort.get("field")), sort.get("dir") or "asc") if sort else None,
            int(limit) if isinstance(limit, (int, float)) and not isinstance(limit, bool) else 0,
        )
    if op == "create":
        return Create(entity, data, {k: _end(v) for k, v in _dict(raw.get("resolve")).items()})
    if op == "update":
        return Update(entity, data, filters)
    if op == "delete":
        return Delete(entity, filters)
    if op in ("link", "unlink"):
        return Link(_text(raw.get("relation")), _end(raw.get("from")), _end(raw.get("to")), op)
    if op == "action":
        return Call(_text(raw.get("action")), _dict(raw.get("params")))
    return None
