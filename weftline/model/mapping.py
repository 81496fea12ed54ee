"""The mapping between ontology names and physical tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

import yaml

from ..errors import MappingError


@dataclass(frozen=True)
class TableMap:
    cls: str
    name: str
    primary_key: str
    columns: dict[str, str] = field(default_factory=dict)
    iri: str = ""
    column_iris: dict[str, str] = field(default_factory=dict)
    comment: str = ""

    def physical(self, field_name: str) -> str:
        """Physical column of an ontology field; an unknown name is itself."""
        return self.columns.get(field_name, field_name)


@dataclass(frozen=True)
class Step:
    """One equality: fk_table.fk_column = ref_table.ref_column."""

    fk_table: str
    fk_column: str
    ref_table: str
    ref_column: str

    @property
    def tables(self) -> tuple[str, str]:
        return self.fk_table, self.ref_table


@dataclass(frozen=True)
class RelationMap:
    name: str
    from_class: str
    to_class: str
    steps: tuple[Step, ...]
    junction: str | None = None
    iri: str = ""

    @property
    def is_direct(self) -> bool:
        return self.junction is None

    @property
    def classes(self) -> set[str]:
        return {self.from_class, self.to_class}


@dataclass(frozen=True)
class Mapping:
    tables: dict[str, TableMap]
    relations: dict[str, RelationMap]
    data_source: str = "primary"

    def table(self, cls: str) -> TableMap:
        if cls not in self.tables:
            raise MappingError(f"unknown entity {cls!r}")
        return self.tables[cls]

    def by_table(self, name: str) -> TableMap | None:
        return next((t for t in self.tables.values() if t.name == name), None)

    def by_iri(self, iri: str) -> TableMap | None:
        return next((t for t in self.tables.values() if iri and t.iri == iri), None)

    @property
    def junctions(self) -> set[str]:
        return {r.junction for r in self.relations.values() if r.junction}

    @property
    def foreign_keys(self) -> dict[tuple[str, str], Step]:
        """By (fk_table, ref_table); of several the last one."""
        return {s.tables: s for r in self.relations.values() for s in r.steps}

    def path(self, from_cls: str, to_cls: str) -> tuple[Step, ...] | None:
        """Steps that join two classes: a key of the first, a key of the second, or the first bridge by name."""
        a, b, keys = self.table(from_cls).name, self.table(to_cls).name, self.foreign_keys
        for pair in ((a, b), (b, a)):
            if pair in keys:
                return (keys[pair],)
        for bridge in sorted(self.junctions):
            if (bridge, a) in keys and (bridge, b) in keys:
                return keys[bridge, a], keys[bridge, b]
        return None


def _step(name: str, spec: dict) -> Step:
    lacking = [k for k in ("fk_table", "fk_column", "ref_table", "ref_column") if not spec.get(k)]
    if lacking:
        raise MappingError(f"relation {name!r} lacks {', '.join(lacking)}")
    return Step(spec["fk_table"], spec["fk_column"], spec["ref_table"], spec["ref_column"])


def from_dict(data: dict, ontology=None) -> Mapping:
    """A mapping from its file form; names are checked against the ontology where one is given."""
    known = {c.name: c for c in ontology.classes} if ontology else None
    known_relations = {p.name for p in ontology.object_properties} if ontology else None
    tables: dict[str, TableMap] = {}
    for cls, spec in (data.get("tables") or {}).items():
        if known is not None and cls not in known:
            raise MappingError(f"class {cls!r} is not in the ontology")
        if not spec.get("table") or not spec.get("primary_key"):
            raise MappingError(f"class {cls!r} needs a table and a primary_key")
        if known is not None and spec.get("iri") and spec["iri"] != known[cls].iri:
            raise MappingError(f"class {cls!r} has the IRI {spec['iri']}, the ontology {known[cls].iri}")
        columns, iris = {}, {}
        for name, column in (spec.get("columns") or {}).items():
            if isinstance(column, dict):
                columns[name] = column["column"]
                iris[name] = column.get("iri") or ""
            else:
                columns[name] = column
        tables[cls] = TableMap(cls, spec["table"], spec["primary_key"], columns, spec.get("iri") or "", iris, spec.get("comment") or (known[cls].comment if known else ""))
    by_name: dict[str, str] = {}
    for cls, t in tables.items():
        by_name.setdefault(t.name, cls)
    relations: dict[str, RelationMap] = {}
    for name, spec in (data.get("relations") or {}).items():
        if known_relations is not None and name not in known_relations:
            raise MappingError(f"relation {name!r} is not in the ontology")
        kind = spec.get("type")
        if kind == "direct":
            steps = (_step(name, spec),)
            ends, junction = (steps[0].fk_table, steps[0].ref_table), None
        elif kind == "junction":
            junction = spec.get("junction_table")
            steps = tuple(_step(name, s) for s in spec.get("steps") or ())
            if not junction or len(steps) != 2:
                raise MappingError(f"relation {name!r} needs a junction_table and two steps")
            if any(s.fk_table != junction for s in steps):
                raise MappingError(f"the steps of relation {name!r} must start at {junction}")
            if steps[0].ref_table == steps[1].ref_table:
                raise MappingError(f"relation {name!r} joins {steps[0].ref_table} with itself through a junction, which link can't tell apart")
            ends = (steps[0].ref_table, steps[1].ref_table)
        else:
            raise MappingError(f"relation {name!r} has the type {kind!r}; direct and junction are known")
        for end in ends:
            if end not in by_name:
                raise MappingError(f"relation {name!r} joins {end}, which no class maps to")
        relations[name] = RelationMap(name, by_name[ends[0]], by_name[ends[1]], steps, junction, spec.get("iri") or "")
    return Mapping(tables, relations, data.get("data_source") or "primary")


def load(path: str | Path, ontology=None) -> Mapping:
    return from_dict(yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}, ontology)


def from_schema(schema: dict, ontology, data_source: str = "primary") -> dict:
    """The file form of the mapping onto a generated schema."""
    tables = {t["ontology_iri"]: t for t in schema["tables"] if t.get("ontology_iri") and not t.get("lookup_table")}
    out: dict = {"data_source": data_source, "tables": {}, "relations": {}}
    for cls in ontology.classes:
        t = tables.get(cls.iri) or next((x for x in schema["tables"] if cls.comment and x.get("comment") == cls.comment and not x.get("lookup_table")), None)
        if t is None:
            continue
        own = {c["name"] for c in t["columns"]}
        columns = {p.column: {"iri": p.iri, "column": p.column} for p in ontology.datatype_properties if cls.iri in p.domains and p.column in own}
        out["tables"][cls.name] = {"iri": cls.iri, "table": t["name"], "primary_key": t["primary_key"], "columns": columns}
    names = {spec["iri"]: spec["table"] for spec in out["tables"].values()}
    physical = {t["name"]: t for t in schema["tables"]}
    planned = {r["iri"]: r for r in schema.get("relationships") or ()}
    step = lambda t, k: {"fk_table": t, "fk_column": k["column"], "ref_table": k["references_table"], "ref_column": k["references_column"]}
    for p in ontology.object_properties:
        a, b = names.get(p.domain), names.get(p.range)
        if not a or not b:
            continue
        plan = planned.get(p.iri)
        bridges = [plan["junction_table"]] if plan and plan["kind"] == "junction" else []
        pairs = [(plan["child_table"], plan["parent_table"])] if plan and plan["kind"] == "fk" else [] if plan else [(a, b), (b, a)]
        direct = next(((t, k) for t, target in pairs for k in physical[t]["foreign_keys"] if k["references_table"] == target), None)
        if direct:
            out["relations"][p.name] = {"iri": p.iri, "type": "direct", **step(*direct)}
            continue
        for bridge in bridges or sorted(t["name"] for t in schema["tables"] if len(t["foreign_keys"]) >= 2 and not t["columns"]):
            keys = {k["references_table"]: k for k in reversed(physical[bridge]["foreign_keys"])}
            if a in keys and b in keys:
                out["relations"][p.name] = {"iri": p.iri, "type": "junction", "junction_table": bridge, "steps": [step(bridge, keys[a]), step(bridge, keys[b])]}
                break
    return out


def ownership(mapping: Mapping, identity_class: str, schema: dict | None = None) -> dict[str, str]:
    """Table -> column that must equal the identity: its own key, and direct foreign keys to it."""
    user = mapping.table(identity_class)
    steps = [s for r in mapping.relations.values() for s in r.steps]
    for t in (schema or {}).get("tables", ()):
        steps += [Step(t["name"], k["column"], k["references_table"], k["references_column"]) for k in t["foreign_keys"]]
    out = {s.fk_table: s.fk_column for s in steps if s.ref_table == user.name}
    return out | {user.name: user.primary_key}


def owner_paths(mapping: Mapping, identity_class: str, schema: dict | None = None) -> dict[str, tuple[Step, ...]]:
    """Table -> the fewest foreign keys that lead from it to a table with a column of ``ownership``.

    Of paths of equal length the first by the names of their keys; tables that have such a column are left out.
    """
    steps = {s for r in mapping.relations.values() for s in r.steps}
    for t in (schema or {}).get("tables", ()):
        steps |= {Step(t["name"], k["column"], k["references_table"], k["references_column"]) for k in t["foreign_keys"]}
    owned = ownership(mapping, identity_class, schema)
    out: dict[str, tuple[Step, ...]] = {}
    reached = set(owned)
    while True:
        found: dict[str, tuple[Step, ...]] = {}
        for s in sorted(steps, key=lambda s: (s.fk_table, s.fk_column, s.ref_table, s.ref_column)):
            if s.ref_table in reached and s.fk_table not in reached and s.fk_table not in found:
                found[s.fk_table] = (s, *out.get(s.ref_table, ()))
        if not found:
            return out
        out |= found
        reached |= set(found)
