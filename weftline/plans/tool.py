"""The JSON schema of a batch, with the names that a domain allows."""

from __future__ import annotations

import copy

from ..functions.actions import Actions
from ..model.mapping import Mapping
from .operations import AGGREGATES, DIRECTIONS, OPS

_NAME = "submit_operations"


def _object(properties: dict, required: list[str] | None = None, about: str = "") -> dict:
    out: dict = {"type": "object", "properties": properties}
    return out | ({"required": required} if required else {}) | ({"description": about} if about else {})


# Names of a batch's operations and their properties, which callers write.
def _base() -> dict:
    text, pairs = {"type": "string"}, {"type": "object"}
    end = _object({"entity": dict(text), "filters": dict(pairs)}, ["entity", "filters"])
    hop = _object({"rel": dict(text), "entity": dict(text), "filters": dict(pairs)}, ["rel", "entity"])
    operation = _object(
        {
            "op": {"type": "string", "enum": list(OPS), "description": "What to do. link and unlink join or part two existing entities of a many-to-many relation."},
            "entity": {"type": "string", "description": "Class to query, create, update or delete."},
            "fields": {"type": "array", "items": dict(text), "description": "query: fields to return; all columns without it."},
            "filters": {"type": "object", "description": "Fields and the values they must equal; all must hold."},
            "relations": {"type": "array", "items": hop, "description": "query: relations to follow in order."},
            "data": {"type": "object", "description": "create and update: fields and their new values."},
            "resolve": {"type": "object", "description": "create: relation to a lookup {entity, filters} of the row to refer to."},
            "aggregate": _object({"fn": {"type": "string", "enum": list(AGGREGATES)}, "field": dict(text)}, ["fn"], "query: one number over all rows that fit."),
            "sort": _object({"field": dict(text), "dir": {"type": "string", "enum": list(DIRECTIONS)}}, ["field"], "query: order of the rows."),
            "limit": {"type": "integer", "description": "query: rows at most; 0 for all."},
            "relation": {"type": "string", "description": "link and unlink: a many-to-many relation."},
            "from": end,
            "to": copy.deepcopy(end),
            "action": {"type": "string", "description": "action: its name."},
            "params": {"type": "object", "description": "action: its parameters."},
        },
        ["op"],
    )
    batch = {"type": "array", "items": operation, "description": "Operations in order. All take effect, or none if one fails."}
    return _object({"operations": batch}, ["operations"])


def tool_schema(mapping: Mapping, actions: Actions | None = None) -> dict:
    """{name, description, input_schema}: a new object on each call."""
    schema = _base()
    fields = schema["properties"]["operations"]["items"]["properties"]
    entities = sorted(mapping.tables)
    fields["entity"]["enum"] = entities
    hop = fields["relations"]["items"]["properties"]
    hop["entity"]["enum"], hop["rel"]["enum"] = list(entities), sorted(mapping.relations)
    direct = sorted(n for n, r in mapping.relations.items() if r.is_direct)
    lookup = _object({"entity": {"type": "string", "enum": list(entities)}, "filters": {"type": "object"}}, ["entity", "filters"])
    if direct:
        fields["resolve"] |= {"properties": {n: copy.deepcopy(lookup) for n in direct}, "additionalProperties": False}
    many = sorted(n for n, r in mapping.relations.items() if not r.is_direct)
    if many:
        fields["relation"]["enum"] = many
        ends = sorted({c for n in many for c in mapping.relations[n].classes})
        for side in ("from", "to"):
            fields[side]["properties"]["entity"]["enum"] = list(ends)
    if actions and actions.names():
        fields["action"]["enum"] = actions.names()
    return {"name": _NAME, "description": "Run a batch of operations in the domain's own terms.", "input_schema": schema}
