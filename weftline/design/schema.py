"""The full schema from a plan and its builds, and its forms: StructTypes, DDL, descriptions."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import types as T

from ..errors import PlanError
from ..model.naming import plural, prefixed, snake
from ..model.ontology import Ontology
from ..sources.constraints import from_schema
from .plan import creation_levels

VERSION = 1
SPARK_TYPES = {"string": T.StringType(), "text": T.StringType(), "integer": T.IntegerType(), "decimal": T.DecimalType(12, 2), "boolean": T.BooleanType(), "date": T.DateType(), "datetime": T.TimestampNTZType()}


def reconcile(plan: dict, builds: dict[str, dict], ontology: Ontology) -> dict:
    """Entity tables with injected keys, junction and lookup tables, in an order that can be created."""
    if not plan.get("valid"):
        raise PlanError("the plan is not valid: " + "; ".join(plan.get("errors") or ["no reason given"]))
    if plan["ontology_hash"] != ontology.digest:
        raise PlanError("the ontology changed since it was planned; plan again")
    module_of = {t: m["name"] for m in plan["modules"] for t in m["tables"]}
    tables: dict[str, dict] = {}
    for t in plan["tables"]:
        made = builds.get(module_of[t["name"]])
        if made is None:
            raise PlanError(f"module {module_of[t['name']]} has no build")
        own = next((b for b in made["tables"] if b["name"] == t["name"]), None)
        if own is None:
            raise PlanError(f"the build of {module_of[t['name']]} lacks table {t['name']}")
        tables[t["name"]] = {**t, "columns": [dict(c) for c in own["columns"]], "foreign_keys": []}
    for name, made in builds.items():
        strange = [b["name"] for b in made["tables"] if module_of.get(b["name"]) != name]
        if strange:
            raise PlanError(f"the build of {name} has tables that the plan doesn't give it: {', '.join(strange)}")
    junctions = []
    for r in plan["relationships"]:
        ends = [r["child_table"], r["parent_table"]] if r["kind"] == "fk" else [r["endpoint_a"], r["endpoint_b"]]
        lost = [e for e in ends if e not in tables]
        if lost:
            raise PlanError(f"relationship {r['iri']} names the unknown table {', '.join(lost)}")
        key_to = lambda t, column=None: {"column": column or tables[t]["primary_key"], "references_table": t, "references_column": tables[t]["primary_key"], "not_null": True, "required": True}
        if r["kind"] == "fk":
            child = tables[r["child_table"]]
            if r["fk_column"] in {c["name"] for c in child["columns"]}:
                raise PlanError(f"{child['name']}.{r['fk_column']} is a data column and a foreign key; rename the property")
            child["foreign_keys"].append(key_to(r["parent_table"], r["fk_column"]))
        else:
            junctions.append({"name": r["junction_table"], "comment": f"Associates {ends[0]} with {ends[1]}.", "primary_key": f"{r['junction_table']}_id", "columns": [], "foreign_keys": [key_to(e) for e in ends]})
    lookups = _lookups(tables, ontology)
    everything = lookups + list(tables.values()) + junctions
    names = [t["name"] for t in everything]
    if len(set(names)) < len(names):
        raise PlanError(f"table names occur twice: {', '.join(sorted({n for n in names if names.count(n) > 1}))}")
    links = [{"kind": "fk", "child_table": t["name"], "parent_table": k["references_table"]} for t in everything for k in t["foreign_keys"]]
    links += [{"kind": "fk", "child_table": t["name"], "parent_table": c["references"]["table"]} for t in everything for c in t["columns"] if c.get("references")]
    levels, loops = creation_levels(names, links)
    if loops:
        raise PlanError(f"tables refer to each other in a circle: {loops}")
    return {"schema_version": VERSION, "ontology_hash": ontology.digest, "tables": everything, "creation_order": [n for level in levels for n in level], "relationships": plan["relationships"]}


def _lookups(tables: dict[str, dict], ontology: Ontology) -> list[dict]:
    """A table for each closed value set; columns of its values refer to it."""
    out, by_class = [], {t["ontology_iri"]: t for t in tables.values()}
    names = {v.iri: prefixed(ontology.prefix(v.iri), plural(snake(v.name))) for v in ontology.value_sets}
    for v in ontology.value_sets:
        columns = [{"name": "label", "type": "string", "not_null": True}, {"name": "sort_order", "type": "integer", "not_null": True, "default": 0}, {"name": "active", "type": "boolean", "not_null": True, "default": True}]
        out.append({"name": names[v.iri], "comment": v.comment or f"Values of {v.qname or v.name}", "ontology_iri": v.iri, "lookup_table": True, "primary_key": "code", "primary_key_type": "text", "columns": columns, "foreign_keys": [], "codes": v.codes})
    codes = {v.iri: v.codes for v in ontology.value_sets}
    for p in ontology.datatype_properties:
        if p.range in names:
            for t in filter(None, map(by_class.get, p.domains)):
                for c in t["columns"]:
                    if c["name"] == p.column:
                        c["references"] = {"table": names[p.range], "column": "code"}
                        c["allowed_values"] = list(codes[p.range])
    return out


def write(schema: dict, path: str | Path) -> None:
    Path(path).write_text(json.dumps(schema, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")


def struct_of(table: dict, schema: dict) -> T.StructType:
    """Key, foreign keys, data columns, created_at; a foreign key has its target's type."""
    by_name = {t["name"]: t for t in schema["tables"]}
    key_type = lambda t: T.StringType() if t.get("primary_key_type") == "text" else T.IntegerType()
    fields = [T.StructField(table["primary_key"], key_type(table))]
    fields += [T.StructField(k["column"], key_type(by_name[k["references_table"]])) for k in table["foreign_keys"]]
    fields += [T.StructField(c["name"], SPARK_TYPES[c["type"]]) for c in table["columns"]]
    return T.StructType([*fields, T.StructField("created_at", SPARK_TYPES["datetime"])])


def store_tables(schema: dict) -> list[dict]:
    """What Store.create takes."""
    by_name = {t["name"]: t for t in schema["tables"]}
    out = []
    for n in schema["creation_order"]:
        t = by_name[n]
        defaults = {c["name"]: c["default"] for c in t["columns"] if "default" in c}
        out.append({"name": n, "schema": struct_of(t, schema), "constraints": from_schema(t) | {"defaults": defaults}, "primary_key": t["primary_key"]})
    return out


def ddl(schema: dict) -> str:
    """CREATE TABLE statements in Spark SQL, constraints as informational clauses."""
    out = []
    for t in store_tables(schema):
        rules, table = t["constraints"], next(x for x in schema["tables"] if x["name"] == t["name"])
        quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
        lines = []
        for f in t["schema"].fields:
            sql = f.dataType.simpleString().upper()
            null = " NOT NULL" if f.name in rules["not_null"] else ""
            notes = [f"at most {rules['lengths'][f.name]} characters"] if f.name in rules["lengths"] else []
            notes += [f"refers to {o}.{k}" for c, o, k in rules["foreign"] if c == f.name]
            notes += ["unique"] if f.name in rules["unique"] else []
            comment = f" COMMENT {quote('; '.join(notes))}" if notes else ""
            lines.append(f"  {f.name} {sql}{null}{comment}")
        note = f"\nCOMMENT {quote(table['comment'])}" if table.get("comment") else ""
        out.append(f"CREATE TABLE {t['name']} (\n" + ",\n".join(lines) + f"\n) USING parquet{note};")
    return "\n\n".join(out) + "\n"


def describe(schema: dict) -> str:
    """The schema in words, a line for each column."""
    out = []
    for t in schema["tables"]:
        out.append(f"{t['name']} (key {t['primary_key']}){': ' + t['comment'] if t.get('comment') else ''}")
        out += [f"  {k['column']} -> {k['references_table']}.{k['references_column']}" for k in t["foreign_keys"]]
        out += [f"  {c['name']}: {c['type']}" + (f", one of {', '.join(c['allowed_values'])}" if c.get("allowed_values") else "") for c in t["columns"]]
    return "\n".join(out)


def validation_spec(schema: dict) -> dict:
    """By table: required columns, types and allowed values."""
    return {t["name"]: {"required": [c["name"] for c in t["columns"] if c.get("required")] + [k["column"] for k in t["foreign_keys"] if k.get("required")], "types": {c["name"]: c["type"] for c in t["columns"]}, "allowed": {c["name"]: c["allowed_values"] for c in t["columns"] if c.get("allowed_values")}} for t in schema["tables"]}
