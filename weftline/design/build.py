"""Columns of each module's tables, from datatype properties, with a cache by content."""

from __future__ import annotations

import hashlib
import json
import re
from collections import defaultdict
from dataclasses import asdict, dataclass
from pathlib import Path

from ..errors import PlanError
from ..model.naming import local_name
from ..model.ontology import Ontology

TYPES = ("string", "text", "integer", "decimal", "boolean", "date", "datetime")
# XSD types and the logical types of their columns; all others are strings.
LOGICAL = {
    "string": "string", "normalizedString": "string", "token": "string", "time": "string",
    "integer": "integer", "int": "integer", "long": "integer", "short": "integer", "nonNegativeInteger": "integer", "positiveInteger": "integer",
    "decimal": "decimal", "float": "decimal", "double": "decimal",
    "boolean": "boolean", "date": "date", "dateTime": "datetime",
}
FLAGS = ("not_null", "required", "unique")


@dataclass(frozen=True)
class Column:
    """A data column; ``codes`` are the values of a closed set."""

    name: str
    type: str
    codes: tuple[str, ...] = ()


@dataclass(frozen=True)
class Part:
    """What one table is built from: names that the schema itself gives it, and its data columns."""

    table: str
    taken: tuple[str, ...]
    columns: tuple[Column, ...]


@dataclass(frozen=True)
class Module:
    name: str
    parts: tuple[Part, ...]

    @property
    def digest(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), ensure_ascii=False).encode()).hexdigest()


def _columns(ontology: Ontology) -> dict[str, list[Column]]:
    """Data columns by the IRI of the class they describe."""
    codes = {v.iri: tuple(v.codes) for v in ontology.value_sets}
    out = defaultdict(list)
    for p in ontology.datatype_properties:
        kind = "string" if p.range in codes else LOGICAL.get(local_name(p.range or ""), "string")
        for cls in p.domains:
            out[cls].append(Column(p.column, kind, codes.get(p.range, ())))
    return out


def module_slice(module: str, names: list[str], plan: dict, ontology: Ontology) -> Module:
    """The part of plan and ontology that a module's columns depend on."""
    keys, columns = defaultdict(list), _columns(ontology)
    for r in plan["relationships"]:
        if r["kind"] == "fk":
            keys[r["child_table"]].append(r["fk_column"])
    tables = {t["name"]: t for t in plan["tables"] if t["name"] in names}
    return Module(module, tuple(Part(n, (t["primary_key"], "created_at", *keys[n]), tuple(columns[t["ontology_iri"]])) for n, t in sorted(tables.items())))


def build_module(module: Module) -> dict:
    """A column, not null and required, for each property of each table."""
    flags = {f: f != "unique" for f in FLAGS}
    return {"module": module.name, "tables": [{"name": p.table, "columns": [{"name": c.name, "type": c.type, **flags} for c in p.columns]} for p in module.parts]}


def _wrong_column(column, where: str, seen: set[str], taken: tuple[str, ...]) -> list[str]:
    name = column.get("name") if isinstance(column, dict) else None
    if not isinstance(name, str) or not re.fullmatch(r"[a-z][a-z0-9_]*", name):
        return [f"{where}: {name!r} is no column name"]
    out = [f"{where}.{name} is there twice"] if name in seen else []
    out += [f"{where}.{name} is a name that the schema itself uses"] if name in taken else []
    out += [f"{where}.{name}: type {column.get('type')!r} is not one of {', '.join(TYPES)}"] if column.get("type") not in TYPES else []
    seen.add(name)
    return out + [f"{where}.{name}: {f} is true or false" for f in FLAGS if not isinstance(column.get(f, False), bool)]


def check_build(build: dict, module: Module) -> list[str]:
    """What is wrong with a module's build."""
    if not isinstance(build, dict) or not isinstance(build.get("tables"), list):
        return ["a build is an object with a list of tables"]
    errors = [] if build.get("module") == module.name else [f"the build is of module {build.get('module')!r}, not {module.name!r}"]
    taken, built = {p.table: p.taken for p in module.parts}, []
    for table in build["tables"]:
        name = table.get("name") if isinstance(table, dict) else None
        if not isinstance(name, str) or name not in taken:
            errors.append(f"table {name!r} is not in the module")
            continue
        errors += [f"table {name} is built twice"] if name in built else []
        built.append(name)
        if not isinstance(table.get("columns"), list):
            errors.append(f"{name}: columns are a list")
            continue
        seen: set[str] = set()
        for column in table["columns"]:
            errors += _wrong_column(column, name, seen, taken[name])
    return errors + [f"table {n} is missing" for n in taken if n not in built]


def build(plan: dict, ontology: Ontology, cache: str | Path | None = None) -> dict[str, dict]:
    """Builds by module.  A cached one is used only while its part of the ontology is the same."""
    out = {}
    for m in plan["modules"]:
        module = module_slice(m["name"], m["tables"], plan, ontology)
        file = Path(cache) / f"{module.name}.json" if cache else None
        kept = _cached(file, module.digest)
        if kept is None or check_build(kept, module):
            kept = build_module(module)
            wrong = check_build(kept, module)
            if wrong:
                raise PlanError("; ".join(wrong))
            if file:
                file.parent.mkdir(parents=True, exist_ok=True)
                file.write_text(json.dumps({"slice_hash": module.digest, "build": kept}, indent=2, ensure_ascii=False), encoding="utf-8")
        out[module.name] = kept
    return out


def _cached(file: Path | None, digest: str) -> dict | None:
    try:
        data = json.loads(file.read_text(encoding="utf-8")) if file else {}
        return data["build"] if data.get("slice_hash") == digest else None
    except (OSError, ValueError, AttributeError, KeyError):
        return None
