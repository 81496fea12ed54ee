"""Checks on a whole batch, before anything is read."""

from __future__ import annotations

from ..functions.actions import Actions
from ..model.mapping import Mapping
from .operations import AGGREGATES, DIRECTIONS, OPS

_NOTHING = Actions()


def validate(batch: list, mapping: Mapping, actions: Actions = _NOTHING) -> list[str]:
    """All errors of all operations; numbered if there is more than one operation."""
    if not isinstance(batch, list) or not batch:
        return ["a batch is a list of one operation or more"]
    out = []
    for i, raw in enumerate(batch, 1):
        where = f"operation {i}: " if len(batch) > 1 else ""
        out += [where + e for e in _operation(raw, mapping, actions)]
    return out


def _named(names, allowed, what: str, entity: str) -> list[str]:
    if not all(isinstance(n, str) for n in names):
        return [f"{what}: a field is named by a string"]
    return [f"{what}: {entity} has no field {n!r}; it has {', '.join(sorted(allowed)) or 'none'}" for n in names if n not in allowed]


def _known(name, names) -> bool:
    """Whether a value of any kind is one of the names."""
    return isinstance(name, str) and name in names


def _pairs(value, what: str, mapping: Mapping, entity: str) -> list[str]:
    """Filters of an entity: an object of its fields, or nothing."""
    if value is not None and not isinstance(value, dict):
        return [f"{what}: filters is an object of field and value"]
    return _named(value or {}, mapping.tables[entity].columns, what, entity)


def _operation(raw, mapping: Mapping, actions: Actions) -> list[str]:
    if not isinstance(raw, dict):
        return ["an operation is an object"]
    op = raw.get("op")
    if op not in OPS:
        return [f"op {op!r} is unknown; known are {', '.join(OPS)}" if op else "op is missing"]
    if op == "action":
        name = raw.get("action")
        if not name:
            return ["action: the name is missing"]
        if raw.get("params") is not None and not isinstance(raw["params"], dict):
            return ["action: params is an object"]
        return [] if isinstance(name, str) and actions.get(name) else [f"action {name!r} is not registered; there are {', '.join(actions.names()) or 'none'}"]
    if op in ("link", "unlink"):
        return _link(raw, mapping)
    entity = raw.get("entity")
    if not entity:
        return [f"{op}: entity is missing"]
    if not _known(entity, mapping.tables):
        return [f"{op}: entity {entity!r} is unknown; known are {', '.join(sorted(mapping.tables))}"]
    table = mapping.tables[entity]
    errors = []
    for part in ("filters", "data"):
        if raw.get(part) is not None and not isinstance(raw[part], dict):
            errors.append(f"{part} is an object of field and value")
        else:
            errors += _named(raw.get(part) or {}, table.columns, part, entity)
    if raw.get("fields") is not None and not isinstance(raw["fields"], list):
        errors.append("fields is a list")
    else:
        errors += _named(raw.get("fields") or [], table.columns, "fields", entity)
    errors += _relations(raw.get("relations"), mapping, entity)
    errors += _resolve(raw.get("resolve"), mapping, entity)
    errors += _aggregate_and_sort(raw, table, entity)
    limit = raw.get("limit")
    if limit is not None and (isinstance(limit, bool) or not isinstance(limit, int) or limit < 0):
        errors.append("limit is a whole number of 0 or more")
    if op == "create" and not raw.get("data") and not raw.get("resolve"):
        errors.append("create: data or resolve is needed")
    if op == "update" and not raw.get("data"):
        errors.append("update: data is needed")
    return errors


def _touched(relation, mapping: Mapping) -> set[str]:
    return {t for s in relation.steps for t in s.tables}


def _relations(hops, mapping: Mapping, entity: str) -> list[str]:
    if hops is None:
        return []
    if not isinstance(hops, list):
        return ["relations is a list"]
    errors = []
    for hop in hops:
        if not isinstance(hop, dict):
            errors.append("a relation is an object of rel, entity and filters")
            continue
        rel, other = hop.get("rel"), hop.get("entity")
        relation = mapping.relations.get(rel) if isinstance(rel, str) else None
        if relation is None:
            errors.append(f"relations: {rel!r} is unknown; known are {', '.join(sorted(mapping.relations))}")
        if not _known(other, mapping.tables):
            errors.append(f"relations: entity {other!r} is unknown")
            continue
        if relation is not None and mapping.tables[other].name not in _touched(relation, mapping):
            errors.append(f"relations: {rel} doesn't reach {other}")
        errors += _pairs(hop.get("filters"), f"relations: {rel}", mapping, other)
    return errors


def _resolve(resolve, mapping: Mapping, entity: str) -> list[str]:
    if resolve is None:
        return []
    if not isinstance(resolve, dict):
        return ["resolve is an object of relation and lookup"]
    errors = []
    for rel, spec in resolve.items():
        relation = mapping.relations.get(rel)
        if relation is None:
            errors.append(f"resolve: relation {rel!r} is unknown")
            continue
        if not relation.is_direct:
            errors.append(f"resolve: {rel} goes through a junction; use link after creating")
            continue
        if relation.steps[0].fk_table != mapping.tables[entity].name:
            errors.append(f"resolve: the key of {rel} is not on {entity}")
        other = spec.get("entity") if isinstance(spec, dict) else None
        if not _known(other, mapping.tables):
            errors.append(f"resolve: entity {other!r} of {rel} is unknown")
            continue
        errors += _pairs(spec.get("filters"), f"resolve: {rel}", mapping, other)
    return errors


def _aggregate_and_sort(raw: dict, table, entity: str) -> list[str]:
    errors = []
    aggregate, sort = raw.get("aggregate"), raw.get("sort")
    if aggregate:
        if not isinstance(aggregate, dict) or not _known(aggregate.get("fn"), AGGREGATES):
            errors.append(f"aggregate: fn is one of {', '.join(AGGREGATES)}")
        elif aggregate.get("field"):
            errors += _named([aggregate["field"]], table.columns, "aggregate", entity)
        elif aggregate["fn"] != "count":
            errors.append(f"aggregate: {aggregate['fn']} needs a field")
    if sort:
        if not isinstance(sort, dict) or not sort.get("field"):
            errors.append("sort: the field is missing")
        else:
            errors += _named([sort["field"]], table.columns, "sort", entity)
            if not _known(sort.get("dir", "asc"), DIRECTIONS):
                errors.append(f"sort: dir is {' or '.join(DIRECTIONS)}")
            if aggregate:
                errors.append("sort: an aggregate is a single row")
    return errors


def _link(raw: dict, mapping: Mapping) -> list[str]:
    op, name = raw["op"], raw.get("relation")
    relation = mapping.relations.get(name) if isinstance(name, str) else None
    if relation is None:
        return [f"{op}: relation {name!r} is unknown" if name else f"{op}: relation is missing"]
    if relation.is_direct:
        return [f"{op}: {name} is not many-to-many; set it with resolve"]
    errors, ends = [], []
    for side in ("from", "to"):
        end = raw.get(side)
        if not isinstance(end, dict) or not _known(end.get("entity"), mapping.tables):
            errors.append(f"{op}: {side} needs a known entity")
            continue
        ends.append(end["entity"])
        if not isinstance(end.get("filters"), dict) or not end["filters"]:
            errors.append(f"{op}: {side} needs filters that fit one {end['entity']}")
        else:
            errors += _named(end["filters"], mapping.tables[end["entity"]].columns, f"{op}: {side}", end["entity"])
    if len(ends) == 2 and set(ends) != relation.classes:
        errors.append(f"{op}: {name} joins {relation.from_class} and {relation.to_class}, not {ends[0]} and {ends[1]}")
    return errors
