"""Domains: a folder with a manifest, an ontology, a mapping and data sources."""

from __future__ import annotations

import configparser
import json
import os
import tempfile
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import SparkSession

from .design import build, plan, schema, seed
from .engine import Engine
from .errors import MappingError, PlanError
from .functions.actions import Actions
from .model import mapping as maps
from .model import ontology as onto
from .sources.store import Store


@dataclass(frozen=True)
class DataSource:
    name: str
    store: str
    folder: Path
    mapping: Path

    @property
    def overrides(self) -> Path:
        return self.folder / "overrides.yaml"


@dataclass(frozen=True)
class Domain:
    name: str
    folder: Path
    description: str
    ontology: Path
    identity_entity: str | None
    sources: dict[str, DataSource]
    rules: Path | None = None
    prompt: Path | None = None
    generated: dict[str, str] = field(default_factory=dict)

    def source(self, name: str | None = None) -> DataSource:
        """The named source, or the first one."""
        if not self.sources:
            raise MappingError(f"domain {self.name} has no data source")
        if name is not None and name not in self.sources:
            raise MappingError(f"domain {self.name} has no data source {name!r}; it has {', '.join(self.sources)}")
        return self.sources[name] if name else next(iter(self.sources.values()))

    def made(self, kind: str, source: DataSource) -> Path:
        return source.folder / self.generated.get(kind, {"schema_plan": "schema_plan.yaml", "schema": "schema.json", "seed_data": "seed_data.sql", "ddl": "schema.sql"}[kind])


def load(folder: str | Path) -> Domain:
    folder = Path(folder)
    try:
        data = json.loads((folder / "domain.json").read_text(encoding="utf-8"))
    except (OSError, ValueError) as e:
        raise MappingError(f"{folder}/domain.json: {e}") from e
    if not data.get("ontology"):
        raise MappingError(f"{folder}/domain.json names no ontology")
    declared = data.get("data_sources") or ({"primary": {"store": data["database_name"]}} if data.get("database_name") else {})
    sources = {}
    for name, spec in declared.items():
        at = folder / spec.get("source_dir", f"data_sources/{name}")
        sources[name] = DataSource(name, spec.get("store") or name, at, at / spec.get("mapping", "mapping.yaml"))
    optional = lambda key: folder / data[key] if data.get(key) else None
    return Domain(data.get("name") or folder.name, folder, data.get("description", ""), folder / data["ontology"], data.get("identity_entity"), sources, optional("business_rules"), optional("system_prompt"), data.get("generated") or {})


def available(folder: str | Path) -> list[str]:
    return sorted(p.parent.name for p in Path(folder).glob("*/domain.json"))


def update_manifest(folder: str | Path, **changes) -> None:
    """Merge changes into the manifest; readers see the old file or the new one, never a part."""
    path = Path(folder) / "domain.json"
    data = json.loads(path.read_text(encoding="utf-8")) | changes
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=".domain-")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(data, f, indent=2, ensure_ascii=False)
        f.flush()
        os.fsync(f.fileno())
    os.replace(name, path)


def store_paths(path: str | Path) -> dict[str, str]:
    """Roots of stores from an INI file with sections ``[data_source:NAME]`` and the key ``path``."""
    parser = configparser.ConfigParser()
    if not parser.read(path, encoding="utf-8"):
        raise MappingError(f"{path} can't be read")
    out, lacking = {}, []
    for section in parser.sections():
        kind, _, name = section.partition(":")
        if kind == "data_source":
            if parser.get(section, "path", fallback=""):
                out[name] = parser.get(section, "path")
            else:
                lacking.append(f"[{section}] path")
    if lacking:
        raise MappingError(f"{path} lacks {', '.join(lacking)}")
    return out


def design(domain: Domain, source: str | None = None, write: bool = True) -> dict:
    """Plan, build and reconcile a source's schema; files are written beside its mapping."""
    at, ontology = domain.source(source), onto.load(domain.ontology)
    planned = plan.design(ontology, plan.load_overrides(at.overrides))
    if write:
        at.folder.mkdir(parents=True, exist_ok=True)
        plan.write(planned, domain.made("schema_plan", at))
    elif not planned["valid"]:
        raise PlanError("; ".join(planned["errors"]))
    made = schema.reconcile(planned, build.build(planned, ontology, at.folder / "build" if write else None), ontology)
    if write:
        schema.write(made, domain.made("schema", at))
        domain.made("ddl", at).write_text(schema.ddl(made), encoding="utf-8")
        if not at.mapping.exists():
            import yaml

            at.mapping.write_text(yaml.safe_dump(maps.from_schema(made, ontology, at.name), sort_keys=False, allow_unicode=True), encoding="utf-8")
    return made


def install(spark: SparkSession, made: dict, root: str, seed_text: str | None = None, replace: bool = False, rows: int | None = None, seed_files: str | None = None) -> Store:
    """A store with the schema's tables, seeded from INSERT text, from files of it (of any size) or by rule (``rows`` each)."""
    store = Store(spark, root)
    if replace:
        store.drop()
    store.create(schema.store_tables(made))
    if seed_text is not None:
        seed.load_inserts(store, seed_text)
    elif seed_files is not None:
        seed.load_insert_files(store, seed_files)
    elif rows:
        seed.fill(store, made, rows)
    return store


def engine(spark: SparkSession, domain: Domain, root: str, source: str | None = None, transitive: bool = False, **options) -> Engine:
    """The domain's mapping, actions and ownership over a store; ``transitive`` scopes tables by chains of keys too."""
    at, ontology = domain.source(source), onto.load(domain.ontology)
    mapping = maps.load(at.mapping, ontology)
    owned = maps.ownership(mapping, domain.identity_entity) if domain.identity_entity else {}
    if transitive and domain.identity_entity:
        options["paths"] = maps.owner_paths(mapping, domain.identity_entity)
    actions = Actions()
    actions.load(domain.folder / "actions")
    return Engine(spark, mapping, Store(spark, root), actions, owned, **options)
