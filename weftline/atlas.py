"""Domains made from the region and nation tables, and queries over every step from ontology to store, with their SQL.

The ontology of ``atlas`` has a class for each region and nation, so plans, builds, mappings and texts made from
it follow from the tables' rows.  ``pair`` has the two classes Region and Nation and is installed from INSERT text.  Only
these two tables, whose size is fixed, are read to the driver.
"""

from __future__ import annotations

import json
import tempfile
import warnings
from collections.abc import Callable
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

from . import domain
from .design import build, plan, schema, seed
from .engine import Engine
from .errors import PlanError
from .model import mapping as maps
from .model import ontology as onto
from .model.naming import local_name
from .plans.operations import parse
from .plans.tool import tool_schema
from .plans.validate import validate
from .sources.catalog import ParquetCatalog
from .sources.store import Store
from .star import _NEW_SQL, _ORDERS, CASTS, CLASSES, DIRECT, _hop, _root, _store_engine, _written, star_engine

NS = "https://example.org/atlas#"
HEAD = f"@prefix owl: <http://www.w3.org/2002/07/owl#> .\n@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\n@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .\n@prefix geo: <{NS}> .\n"


def _camel(name: str) -> str:
    return "".join(w.capitalize() for w in name.replace("_", " ").split())


def _nations(spark: SparkSession, sf_dir: str) -> list[tuple[int, str, str]]:
    """(key, class of the nation, class of its region)."""
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    rows = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select("n_nationkey", "n_name", "r_name").collect()
    return [(k, _camel(n), _camel(r)) for k, n, r in sorted(map(tuple, rows))]


def _text(rows: list[tuple[int, str, str]], leaders: bool = False) -> str:
    """The ontology; with ``leaders`` each region refers back to its first nation, and each has a property of a union."""
    regions = sorted({r for _, _, r in rows})
    out = [HEAD] + [f'geo:{r} a owl:Class ; rdfs:comment "The region {r}." .' for r in regions]
    for k, n, r in rows:
        out.append(f'geo:{n} a owl:Class ; rdfs:comment "The nation {n}." .')
        note = ' ; rdfs:comment "A many-to-many relation."' if r == "MiddleEast" else ""
        out.append(f"geo:in{n} a owl:ObjectProperty ; rdfs:domain geo:{n} ; rdfs:range geo:{r}{note} .")
        out.append(f"geo:code{n} a owl:DatatypeProperty ; rdfs:domain geo:{n} ; rdfs:range xsd:{'integer' if k % 2 else 'decimal'} .")
    for r in regions if leaders else ():
        own = [n for _, n, x in rows if x == r]
        out.append(f"geo:lead{r} a owl:ObjectProperty ; rdfs:domain geo:{r} ; rdfs:range geo:{own[0]} .")
        out.append(f"geo:near{r} a owl:ObjectProperty ; rdfs:domain [ a owl:Class ; owl:unionOf ( {' '.join(f'geo:{n}' for n in own)} ) ] ; rdfs:range geo:{r} .")
    return "\n".join(out)


def _overrides(rows) -> dict:
    """Named by IRI, qualified name or local name in turn."""
    form = lambda k, name: (f"{NS}{name}", f"geo:{name}", name)[k % 3]
    return {
        "fk_parent": {form(k, f"in{n}"): "domain" for k, n, r in rows if r == "Asia"},
        "ignore_classes": [form(k, n) for k, n, r in rows if r == "Africa" and k > 9],
        "modules": {r.lower(): [form(k, n) for k, n, x in rows if x == r] for r in ("Europe", "America")},
    }


def _planned(spark, sf_dir) -> tuple:
    """(rows, ontology, plan); overrides go through their file."""
    rows = _nations(spark, sf_dir)
    o = onto.parse(_text(rows))
    with tempfile.TemporaryDirectory(prefix="atlas-") as folder:
        Path(folder, "overrides.yaml").write_text(yaml.safe_dump(_overrides(rows)), encoding="utf-8")
        return rows, o, plan.design(o, plan.load_overrides(Path(folder, "overrides.yaml")))


def _made(spark, sf_dir) -> tuple:
    rows, o, p = _planned(spark, sf_dir)
    s = schema.reconcile(p, build.build(p, o), o)
    return rows, o, p, s, maps.from_dict(maps.from_schema(s, o), o)


def _frame(spark: SparkSession, rows: list, kind: str) -> DataFrame:
    return spark.createDataFrame(rows, kind)


def _relationships(spark, sf_dir):
    _, _, p = _planned(spark, sf_dir)
    rows = [(local_name(r["iri"]), r["kind"], r.get("child_table") or r["endpoint_a"], r.get("parent_table") or r["endpoint_b"], r.get("fk_column") or r["junction_table"]) for r in p["relationships"]]
    return _frame(spark, rows, "property string, kind string, one string, other string, through string")


def _circles(spark, sf_dir):
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        p = plan.design(onto.parse(_text(_nations(spark, sf_dir), leaders=True)))
    unions = {str(w.message).split()[0] for w in told if "union" in str(w.message)}
    with tempfile.TemporaryDirectory(prefix="atlas-") as folder:
        file = Path(folder, "plan.yaml")
        try:
            plan.write(p, file)
        except PlanError:
            written = yaml.safe_load(file.read_text(encoding="utf-8"))
    circles = [("circle", " ".join(sorted(loop))) for loop in written["cycles"]]
    return _frame(spark, [*circles, *(("union", u) for u in unions), ("valid", str(written["valid"]).lower()), ("errors", str(len(written["errors"])))], "what string, value string")


def _builds(spark, sf_dir):
    """By module: the cache is used while its part is the same, and rebuilt when broken or of another part."""
    _, o, p = _planned(spark, sf_dir)
    out = []
    with tempfile.TemporaryDirectory(prefix="atlas-") as folder:
        first = build.build(p, o, folder)
        files = {m["name"]: Path(folder, f"{m['name']}.json") for m in p["modules"]}
        text = {n: f.read_text() for n, f in files.items()}

        def after(change) -> dict:
            for n, f in files.items():
                f.write_text(change(text[n]))
            return build.build(p, o, folder)

        trusted = after(lambda t: t.replace('"unique": false', '"unique": true'))
        broken, other = after(lambda t: t[:-9]), after(lambda t: t.replace('"slice_hash": "', '"slice_hash": "0'))
        for m in p["modules"]:
            n = m["name"]
            part = build.module_slice(n, m["tables"], p, o)
            wrong = json.loads(json.dumps(first[n]))
            for t in wrong["tables"]:
                t["columns"].append({"name": "Not A Name", "type": "string"})
            has_columns = any(t["columns"] for t in first[n]["tables"])
            out.append((n, (trusted[n] != first[n]) == has_columns, broken[n] == first[n], other[n] == first[n], len(build.check_build(wrong, part)), len(build.check_build({**wrong, "tables": []}, part))))
    return _frame(spark, out, "module string, trusted boolean, after_broken boolean, after_other boolean, wrong_names int, missing int")


def _columns(spark, sf_dir):
    _, o, p = _planned(spark, sf_dir)
    rows = [(n, t["name"], c["name"], c["type"]) for n, b in build.build(p, o).items() for t in b["tables"] for c in t["columns"]]
    return _frame(spark, rows, "module string, table_name string, column_name string, type string")


def _ddl_lines(spark, sf_dir):
    rows, _, _, s, _ = _made(spark, sf_dir)
    names = {f"geo_{n.lower()}s" for _, n, _ in rows}
    out = []
    for statement in schema.ddl(s).split(";\n"):
        head, *lines = statement.strip().split("\n")
        name = head.split()[2] if head else ""
        out += [(name, line.strip().rstrip(",")) for line in lines if name in names and line.startswith("  ")]
    return _frame(spark, out, "table_name string, line string")


def _described(spark, sf_dir):
    s = _made(spark, sf_dir)[3]
    return _frame(spark, [(x,) for x in schema.describe(s).split("\n")], "line string")


def _mapped(spark, sf_dir):
    """Entities and relations of the mapping; the same one is found by comments where tables lack an IRI."""
    _, o, _, s, m = _made(spark, sf_dir)
    bare = {**s, "tables": [{k: v for k, v in t.items() if k != "ontology_iri"} for t in s["tables"]]}
    again = maps.from_dict(maps.from_schema(bare, o), o)
    rows = [(t.cls, t.name, t.primary_key, again.tables[t.cls].name == t.name) for t in m.tables.values()]
    rows += [(r.name, r.from_class, r.to_class, again.relations[r.name].steps == r.steps) for r in m.relations.values()]
    return _frame(spark, rows, "name string, one string, other string, by_comment boolean")


def _owned(spark, sf_dir):
    m = _made(spark, sf_dir)[4]
    rows = [(i, t, c) for i in ("Europe", "Asia", "MiddleEast") for t, c in maps.ownership(m, i).items()]
    return _frame(spark, rows, "identity string, table_name string, column_name string")


def _paths(spark, sf_dir):
    rows, _, _, _, m = _made(spark, sf_dir)
    regions = sorted({r for _, _, r in rows})
    out = []
    for _, n, _ in rows:
        for r in regions if n in m.tables else ():
            steps = m.path(n, r)
            out.append((n, r, None if steps is None else " & ".join(f"{s.fk_table}.{s.fk_column} = {s.ref_table}.{s.ref_column}" for s in steps)))
    return _frame(spark, out, "nation string, region string, path string")


def _tool(spark, sf_dir):
    m = _made(spark, sf_dir)[4]
    fields = tool_schema(m)["input_schema"]["properties"]["operations"]["items"]["properties"]
    lists = {"entity": fields["entity"]["enum"], "rel": fields["relations"]["items"]["properties"]["rel"]["enum"], "resolve": fields["resolve"]["properties"], "relation": fields["relation"]["enum"], "from": fields["from"]["properties"]["entity"]["enum"]}
    return _frame(spark, [(k, v) for k, vs in lists.items() for v in vs], "place string, value string")


def _parsed(spark, sf_dir):
    out = []
    for k, n, r in _nations(spark, sf_dir):
        q = parse({"op": "query", "entity": n, "limit": k + 0.75, "fields": [r, k, None], "filters": ["no object"], "sort": {"field": r}, "relations": [{"rel": f"in{n}", "entity": r}, "no hop"]})
        out.append((q.entity, q.limit, ",".join(q.fields), len(q.filters), q.sort[1], len(q.relations)))
    return _frame(spark, out, "entity string, n int, fields string, filters int, direction string, hops int")


def _numbered(spark, sf_dir):
    rows, *_, m = _made(spark, sf_dir)
    batch = [{"op": "query", "entity": n, "fields": [f"name{k}"]} for k, n, _ in rows]
    return _frame(spark, [(e,) for e in [*validate(batch, m), *validate(batch[:1], m)]], "error string")


#: Every nation with the names that the plan gives it; ``role`` is what becomes of its property.
_N = """(SELECT n_nationkey AS k, r_name, n, r, 'geo_' || lower(n) || 's' AS nt, 'geo_' || lower(n) || '_id' AS nk, 'geo_' || rs || 's' AS rt, 'geo_' || rs || '_id' AS rk,
  CASE WHEN r_name = 'AFRICA' AND n_nationkey > 9 THEN 'ignored' WHEN r_name = 'MIDDLE EAST' THEN 'junction' WHEN r_name = 'ASIA' THEN 'parent' ELSE 'child' END AS role,
  CASE WHEN r_name IN ('EUROPE', 'AMERICA') THEN lower(r_name) ELSE 'geo' END AS module, 'code_nation' || n_nationkey AS code, CASE WHEN n_nationkey % 2 = 1 THEN 'integer' ELSE 'decimal' END AS kind
  FROM (SELECT *, 'Nation' || n_nationkey AS n, CASE r_name WHEN 'MIDDLE EAST' THEN 'MiddleEast' ELSE r_name[1] || lower(r_name[2:]) END AS r, replace(lower(r_name), ' ', '_') AS rs FROM nation JOIN region ON n_regionkey = r_regionkey))"""
_R = f"(SELECT DISTINCT r_name, r, rt, rk FROM {_N})"

PLANS: dict[str, tuple[Callable, str]] = {
    "a_relationships": (_relationships, f"SELECT 'in' || n AS property, CASE role WHEN 'junction' THEN 'junction' ELSE 'fk' END AS kind, CASE role WHEN 'parent' THEN rt ELSE nt END AS one, CASE role WHEN 'parent' THEN nt ELSE rt END AS other, CASE role WHEN 'junction' THEN 'geo_' || lower(n) || '_middle_easts' WHEN 'parent' THEN nk ELSE rk END AS through FROM {_N} WHERE role <> 'ignored'"),
    "a_modules": (lambda spark, sf_dir: _frame(spark, [(m["name"], t) for m in _planned(spark, sf_dir)[2]["modules"] for t in m["tables"]], "module string, table_name string"), f"SELECT module, nt AS table_name FROM {_N} WHERE role <> 'ignored' UNION ALL SELECT 'geo', rt FROM {_R}"),
    "a_levels": (lambda spark, sf_dir: _frame(spark, [(o["level"], t) for o in _planned(spark, sf_dir)[2]["creation_order"] for t in o["tables"]], "level int, table_name string"), f"SELECT CASE role WHEN 'child' THEN 1 ELSE 0 END AS level, nt AS table_name FROM {_N} WHERE role <> 'ignored' UNION ALL SELECT CASE r_name WHEN 'ASIA' THEN 1 ELSE 0 END, rt FROM {_R}"),
    "a_circles": (_circles, f"WITH f AS (SELECT r_name, rt, arg_min(nt, k) AS nt, any_value(r) AS r FROM {_N} GROUP BY 1, 2) SELECT 'circle' AS what, least(nt, rt) || ' ' || greatest(nt, rt) AS value FROM f WHERE r_name <> 'MIDDLE EAST' UNION ALL SELECT 'union', 'geo:near' || r FROM f UNION ALL SELECT 'valid', 'false' UNION ALL SELECT 'errors', CAST(count(*) AS VARCHAR) FROM f WHERE r_name <> 'MIDDLE EAST'"),
    "a_columns": (_columns, f"SELECT module, nt AS table_name, code AS column_name, kind AS type FROM {_N} WHERE role <> 'ignored'"),
    "a_builds": (_builds, f"WITH t AS (SELECT module, nt FROM {_N} WHERE role <> 'ignored' UNION ALL SELECT 'geo', rt FROM {_R}) SELECT module, true AS trusted, true AS after_broken, true AS after_other, CAST(count(*) AS INT) AS wrong_names, CAST(count(*) AS INT) AS missing FROM t GROUP BY module"),
    "a_ddl_lines": (_ddl_lines, f"WITH n AS (SELECT * FROM {_N} WHERE role <> 'ignored') SELECT nt AS table_name, nk || ' INT NOT NULL COMMENT ''unique''' AS line FROM n UNION ALL SELECT nt, rk || ' INT NOT NULL COMMENT ''refers to ' || rt || '.' || rk || '''' FROM n WHERE role = 'child' UNION ALL SELECT nt, code || CASE kind WHEN 'integer' THEN ' INT' ELSE ' DECIMAL(12,2)' END || ' NOT NULL' FROM n UNION ALL SELECT nt, 'created_at TIMESTAMP_NTZ' FROM n"),
    "a_described": (_described, f"WITH n AS (SELECT * FROM {_N} WHERE role <> 'ignored') SELECT nt || ' (key ' || nk || '): The nation ' || n || '.' AS line FROM n UNION ALL SELECT '  ' || code || ': ' || kind FROM n UNION ALL SELECT rt || ' (key ' || rk || '): The region ' || r || '.' FROM {_R} UNION ALL SELECT CASE role WHEN 'child' THEN '  ' || rk || ' -> ' || rt || '.' || rk ELSE '  ' || nk || ' -> ' || nt || '.' || nk END FROM n UNION ALL SELECT '  ' || rk || ' -> ' || rt || '.' || rk FROM n WHERE role = 'junction' UNION ALL SELECT 'geo_' || lower(n) || '_middle_easts (key geo_' || lower(n) || '_middle_easts_id): Associates ' || nt || ' with ' || rt || '.' FROM n WHERE role = 'junction'"),
    "a_mapped": (_mapped, f"WITH n AS (SELECT * FROM {_N} WHERE role <> 'ignored') SELECT n AS name, nt AS one, nk AS other, true AS by_comment FROM n UNION ALL SELECT r, rt, rk, true FROM {_R} UNION ALL SELECT 'in' || n, CASE role WHEN 'parent' THEN r ELSE n END, CASE role WHEN 'parent' THEN n ELSE r END, true FROM n"),
    "a_owned": (_owned, f"SELECT r AS identity, rt AS table_name, rk AS column_name FROM {_R} WHERE r IN ('Europe', 'Asia', 'MiddleEast') UNION ALL SELECT r, CASE role WHEN 'junction' THEN 'geo_' || lower(n) || '_middle_easts' ELSE nt END, rk FROM {_N} WHERE r IN ('Europe', 'MiddleEast')"),
    "a_paths": (_paths, f"SELECT n.n AS nation, o.r AS region, CASE WHEN n.r <> o.r THEN NULL WHEN role = 'junction' THEN 'geo_' || lower(n.n) || '_middle_easts.' || nk || ' = ' || nt || '.' || nk || ' & geo_' || lower(n.n) || '_middle_easts.' || n.rk || ' = ' || n.rt || '.' || n.rk WHEN role = 'parent' THEN n.rt || '.' || nk || ' = ' || nt || '.' || nk ELSE nt || '.' || n.rk || ' = ' || n.rt || '.' || n.rk END AS path FROM {_N} n, {_R} o WHERE role <> 'ignored'"),
    "a_tool": (_tool, f"WITH n AS (SELECT * FROM {_N} WHERE role <> 'ignored') SELECT 'entity' AS place, n AS value FROM n UNION ALL SELECT 'entity', r FROM {_R} UNION ALL SELECT 'rel', 'in' || n FROM n UNION ALL SELECT CASE role WHEN 'junction' THEN 'relation' ELSE 'resolve' END, 'in' || n FROM n UNION ALL SELECT 'from', n FROM n WHERE role = 'junction' UNION ALL SELECT DISTINCT 'from', r FROM n WHERE role = 'junction'"),
    "a_parsed": (_parsed, f"SELECT n AS entity, k AS n, r AS fields, 0 AS filters, 'asc' AS direction, 1 AS hops FROM {_N}"),
    "a_numbered": (_numbered, f"WITH e AS (SELECT k, CASE role WHEN 'ignored' THEN 'query: entity ''' || n || ''' is unknown; known are ' || (SELECT string_agg(name, ', ' ORDER BY name) FROM (SELECT n AS name FROM {_N} WHERE role <> 'ignored' UNION SELECT r FROM {_R})) ELSE 'fields: ' || n || ' has no field ''name' || k || '''; it has ' || code END AS error FROM {_N}) SELECT 'operation ' || (k + 1) || ': ' || error AS error FROM e UNION ALL SELECT error FROM e WHERE k = 0"),
}

# the pair of classes, installed

PAIR = HEAD + """
geo:Region a owl:Class ; rdfs:comment "A region." .
geo:Nation a owl:Class ; rdfs:comment "A nation." .
geo:inRegion a owl:ObjectProperty ; rdfs:domain geo:Nation ; rdfs:range geo:Region .
geo:regionName a owl:DatatypeProperty ; rdfs:domain geo:Region ; rdfs:range xsd:string .
geo:nationName a owl:DatatypeProperty ; rdfs:domain geo:Nation ; rdfs:range xsd:string .
"""


def _inserts(spark, sf_dir, shift: int = 0) -> str:
    """INSERT text of both tables; generated keys start at 1, and ``shift`` moves the nations' regions."""
    region, nation = (sorted(map(tuple, spark.read.parquet(f"{sf_dir}/{t}.parquet").collect())) for t in ("region", "nation"))
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    lines = ["-- regions; then nations", "INSERT INTO geo_regions (region_name) VALUES " + ", ".join(f"({quoted(n)})" for _, n in region) + ";"]
    return "\n".join([*lines, "INSERT INTO geo_nations (nation_name, geo_region_id) VALUES " + ", ".join(f"({quoted(n)}, {r + 1 + shift})" for _, n, r in nation) + ";"])


class _Pair:
    """A folder with the pair's domain and an action for each region; its store is under the shared folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, label: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.folder = tempfile.TemporaryDirectory(prefix="pair-")
        at = Path(self.folder.name, "pair")
        (at / "actions").mkdir(parents=True)
        (at / "pair.ttl").write_text(PAIR)
        (at / "domain.json").write_text(json.dumps({"name": "Pair", "ontology": "pair.ttl", "identity_entity": "Region", "database_name": "pair"}))
        self.at, self.root = at, _root(spark, label)
        Path(self.folder.name, "stores.ini").write_text(f"[data_source:primary]\npath = {self.root}\n")

    def engine(self, seed_text: str | None = None, rows: int | None = None, replace: bool = False):
        d = domain.load(self.at)
        root = domain.store_paths(Path(self.folder.name, "stores.ini"))[d.source().name]
        domain.install(self.spark, domain.design(d), root, seed_text, replace, rows)
        return domain.engine(self.spark, d, root)


def _installed(spark, sf_dir):
    e = _Pair(spark, sf_dir, "install").engine(_inserts(spark, sf_dir))
    return e.frame({"op": "query", "entity": "Nation", "relations": [_hop("inRegion", "Region", region_name="ASIA")], "fields": ["nation_name"]})


def _installed_again(spark, sf_dir):
    pair = _Pair(spark, sf_dir, "again")
    pair.engine(_inserts(spark, sf_dir))
    e = pair.engine(_inserts(spark, sf_dir), replace=True)
    frames = e.frames([{"op": "query", "entity": c, "aggregate": {"fn": "count"}} for c in ("Region", "Nation")])
    return frames[0].unionByName(frames[1])


def _ready(spark, sf_dir):
    store = Store(spark, _root(spark, "ready"))
    out = [("new", store.ready())]
    for t in ("region", "nation"):
        store.load(t, spark.read.parquet(f"{sf_dir}/{t}.parquet"))
    out.append(("loaded", store.ready()))
    store.drop_tables(["region"])
    out += [("region dropped", "region" not in store.manifest()["tables"]), ("rest ready", store.ready() and store.table("nation").count() > 0)]
    store.drop()
    return _frame(spark, [*out, ("dropped", store.ready())], "state string, ready boolean")


def _checked(spark, sf_dir):
    pair = _Pair(spark, sf_dir, "check")
    e = pair.engine()
    shift = 100
    errors = seed.check_inserts(e.source, _inserts(spark, sf_dir, shift))
    lost = min(int(x.rpartition(" ")[2]) for x in errors)
    return _frame(spark, [(len(errors), lost - shift <= spark.read.parquet(f"{sf_dir}/region.parquet").count(), len(seed.check_inserts(e.source, _inserts(spark, sf_dir))), e.source.table("geo_nations").count())], "wrong int, named boolean, right int, kept long")


def _seeded(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    return _Pair(spark, sf_dir, "seed").engine(rows=n).source.table("geo_regions").drop("created_at")


def _acted(spark, sf_dir):
    """An action file for each region counts its nations."""
    pair = _Pair(spark, sf_dir, "act")
    names = [r["r_name"] for r in spark.read.parquet(f"{sf_dir}/region.parquet").collect()]
    for i, name in enumerate(names):
        body = f"DEFINITION = {{'name': 'count_{i}', 'description': {name!r}}}\n\ndef execute(params, context, mapping):\n    r = context.table('geo_regions').where(\"region_name = {name!r}\").select('geo_region_id')\n    return context.table('geo_nations').join(r, 'geo_region_id').count()\n"
        (pair.at / "actions" / f"count_{i}.py").write_text(body)
    (pair.at / "actions" / "_not_loaded.py").write_text("raise ValueError")
    e = pair.engine(_inserts(spark, sf_dir))
    result = e.execute([{"op": "action", "action": f"count_{i}"} for i in range(len(names))])
    about = {d["name"]: d["description"] for d in e.actions.definitions()}
    return _frame(spark, [(about[x["op"]["action"]], x["result"]) for x in result.log], "r_name string, nations string")


def _manifests(spark, sf_dir):
    """A folder for each region, whose manifest is changed; folders and stores are listed."""
    out = []
    with tempfile.TemporaryDirectory(prefix="atlas-") as folder:
        names = sorted({r for _, _, r in _nations(spark, sf_dir)})
        for n in names:
            Path(folder, n).mkdir()
            Path(folder, n, "domain.json").write_text(json.dumps({"ontology": "x.ttl", "database_name": n}))
            domain.update_manifest(Path(folder, n), description=f"all of {n}")
        ini = Path(folder, "stores.ini")
        ini.write_text("".join(f"[data_source:{n}]\npath = /stores/{n}\n" for n in names))
        paths = domain.store_paths(ini)
        for n in domain.available(folder):
            d = domain.load(Path(folder, n))
            out.append((d.name, d.description, d.source().store, paths[d.source().store]))
    return _frame(spark, out, "name string, description string, store string, path string")


# texts and refusals over the star tables


def _said(*batches: list[dict], tables: tuple = (), identity=None) -> Callable:
    """The text of each batch and whether it went through."""

    def run(spark, sf_dir):
        e = _store_engine(spark, sf_dir, *tables) if tables else star_engine(spark, sf_dir)
        results = [e.execute(b, identity) for b in batches]
        return _frame(spark, [(i, r.ok, r.text) for i, r in enumerate(results)], "batch int, ok boolean, text string")

    return run


def _logged(spark, sf_dir):
    e = _store_engine(spark, sf_dir, "region", "nation")
    r = e.execute([{"op": "query", "entity": "Nation", "filters": {"nation_key": 3}}, {"op": "update", "entity": "Region", "data": {"name": "X"}}, {"op": "query", "entity": "Region", "fields": ["name"]}])
    rows = [(i, x["op"]["op"], x["is_write"], "n_nationkey" in x["plan"] and "3" in x["plan"], len(x["result"]["returned_data"] if x["is_write"] else x["result"])) for i, x in enumerate(r.log)]
    return _frame(spark, rows, "number int, op string, is_write boolean, plan_of_3 boolean, n int")


def _sorted_with_null(direction: str) -> Callable:
    batch = [{"op": "update", "entity": "Customer", "filters": {"customer_key": 4}, "data": {"balance": None}}, {"op": "query", "entity": "Customer", "fields": ["customer_key", "balance"], "sort": {"field": "balance", "dir": direction}, "limit": 20}]
    return _written(("customer",), batch, "returned")


def _linked(op: str, identity: int | None = None) -> Callable:
    """Order 1 and part 1 through the line items, as the identity sees them."""

    def run(spark, sf_dir):
        store = Store(spark, _root(spark, "link"))
        for t in ("orders", "part", "lineitem"):
            store.load(t, ParquetCatalog(spark, sf_dir, CASTS).table(t))
        step = lambda s: dict(zip(("fk_table", "fk_column", "ref_table", "ref_column"), s, strict=True))
        tables = {c: {"table": CLASSES[c][0], "primary_key": CLASSES[c][1], "columns": CLASSES[c][2]} for c in ("Order", "Part")}
        m = maps.from_dict({"tables": tables, "relations": {"holds": {"type": "junction", "junction_table": "lineitem", "steps": [step(DIRECT["lineOfOrder"]), step(DIRECT["linePart"])]}}})
        e = Engine(spark, m, store, owned={"orders": "o_custkey"})
        ends = {"from": {"entity": "Order", "filters": {"order_key": 1}}, "to": {"entity": "Part", "filters": {"part_key": 1}}}
        e.execute([{"op": op, "relation": "holds", **ends}] * 2, identity)
        return e.source.table("lineitem").select("l_orderkey", "l_partkey")

    return run


_PAIR_SQL = "SELECT l_orderkey, l_partkey FROM lineitem"
_NO_PAIR = "NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = 1 AND l_partkey = 1)"
_C20 = "SELECT c_custkey, CASE c_custkey WHEN 4 THEN NULL ELSE CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS DOUBLE) END AS c_acctbal FROM customer ORDER BY 2 {} LIMIT 20"
_ADVICE = "Correct the operation, ask for what is missing, or go another way; the same values will fail again."
_INVALID = "The batch is not valid; nothing was run:\n- {}\n\nCorrect the operations and send them again."
_MISS = {"op": "create", "entity": "Order", "data": {"status": "P", "total": 12.5, "ordered_at": "2001-02-03", "priority": "2-HIGH"}, "resolve": {"placedBy": {"entity": "Customer", "filters": {"name": "nobody"}}}}

STORES: dict[str, tuple[Callable, str]] = {
    "i_installed": (_installed, "SELECT n_name AS nation_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'"),
    "i_installed_again": (_installed_again, "SELECT count(*) AS count FROM region UNION ALL SELECT count(*) FROM nation"),
    "i_ready": (_ready, "SELECT 'new' AS state, false AS ready UNION ALL SELECT 'loaded', count(*) > 0 FROM region UNION ALL SELECT 'region dropped', true UNION ALL SELECT 'rest ready', count(*) > 0 FROM nation UNION ALL SELECT 'dropped', false"),
    "i_checked": (_checked, "SELECT CAST(1 AS INT) AS wrong, count(*) > 0 AS named, CAST(0 AS INT) AS \"right\", CAST(0 AS BIGINT) AS kept FROM nation"),
    "i_seeded": (_seeded, "SELECT CAST(n_nationkey + 1 AS INT) AS geo_region_id, 'region name ' || (n_nationkey + 1) AS region_name FROM nation"),
    "i_manifests": (_manifests, f"SELECT r AS name, 'all of ' || r AS description, r AS store, '/stores/' || r AS path FROM {_R}"),
    "x_action_files": (_acted, "SELECT r_name, CAST(count(*) AS VARCHAR) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "t_scalar": (_said([{"op": "query", "entity": "Order", "aggregate": {"fn": "count"}}], [{"op": "query", "entity": "Customer", "filters": {"customer_key": 5}, "fields": ["name"]}], [{"op": "query", "entity": "Part", "filters": {"brand": "none such"}}]), "SELECT 0 AS batch, true AS ok, CAST(count(*) AS VARCHAR) AS text FROM orders UNION ALL SELECT 1, true, c_name FROM customer WHERE c_custkey = 5 UNION ALL SELECT 2, true, 'No Part records found.' FROM part WHERE p_brand = 'none such' HAVING count(*) = 0"),
    "t_rows": (_said([{"op": "query", "entity": "Region", "sort": {"field": "region_key"}}]), "SELECT 0 AS batch, true AS ok, '[' || chr(10) || string_agg('  {' || chr(10) || '    \"r_regionkey\": ' || r_regionkey || ',' || chr(10) || '    \"r_name\": \"' || r_name || '\"' || chr(10) || '  }', ',' || chr(10) ORDER BY r_regionkey) || chr(10) || ']' AS text FROM region"),
    "t_failure": (
        _said([{"op": "update", "entity": "Region", "data": {"name": "X"}}, {"op": "update", "entity": "Nation", "filters": {"nation_key": 1}, "data": {"nation_key": 2}}], [{"op": "delete", "entity": "Region", "filters": {"region_key": 3}}], tables=("region", "nation")),
        f"SELECT 0 AS batch, false AS ok, 'Operation 2 FAILED:' || chr(10) || 'constraint_violation: nation.n_nationkey must be unique; ' || n_nationkey || ' is there already' || chr(10) || chr(10) || 'The 1 operation(s) before it were rolled back; the store is unchanged.' || chr(10) || chr(10) || '{_ADVICE}' AS text FROM nation WHERE n_nationkey = 2 UNION ALL SELECT DISTINCT 1, false, 'Operation 1 FAILED:' || chr(10) || 'constraint_violation: nation.n_regionkey still refers to region.r_regionkey ' || n_regionkey || chr(10) || chr(10) || '{_ADVICE}' FROM nation WHERE n_regionkey = 3",
    ),
    "t_invalid": (_said([{"op": "update", "entity": "Region", "filters": {"name": "ASIA"}}], tables=("region",)), f"SELECT 0 AS batch, false AS ok, replace('{_INVALID.format('update: data is needed')}', '\\n', chr(10)) AS text FROM region WHERE r_name = 'ASIA'".replace("\n", "\\n")),
    "t_log": (_logged, "SELECT 0 AS number, 'query' AS op, false AS is_write, true AS plan_of_3, CAST(count(*) AS INT) AS n FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 1, 'update', true, false, CAST(count(*) AS INT) FROM region UNION ALL SELECT 2, 'query', false, false, CAST(count(*) AS INT) FROM region"),
    "q_nulls_last": (_sorted_with_null("asc"), _C20.format("ASC NULLS LAST")),
    "q_nulls_first": (_sorted_with_null("desc"), _C20.format("DESC NULLS FIRST")),
    "w_resolve_miss": (_written(("customer", "orders"), [_MISS], "returned"), _NEW_SQL.format(key="(SELECT min(c_custkey) FROM customer WHERE c_name = 'nobody')")),
    "w_update_nothing": (_written(("region",), [{"op": "update", "entity": "Region"}], "region", refused="update: data is needed"), "SELECT * FROM region"),
    "w_unique_refused": (_written(("nation",), [{"op": "create", "entity": "Nation", "data": {"nation_key": 3, "name": "twice"}}], "nation", refused="nation.n_nationkey must be unique; 3"), "SELECT * FROM nation"),
    "w_reference_refused": (_written(("customer", "orders"), [{"op": "delete", "entity": "Customer"}], "orders", refused="orders.o_custkey still refers to customer.c_custkey"), f"SELECT {_ORDERS} FROM orders"),
    "w_linked": (_linked("link"), f"{_PAIR_SQL} UNION ALL SELECT 1, 1 WHERE {_NO_PAIR}"),
    "w_linked_scoped": (_linked("link", 7), f"{_PAIR_SQL} UNION ALL SELECT 1, 1 FROM orders WHERE o_orderkey = 1 AND o_custkey = 7 AND {_NO_PAIR}"),
    "w_unlinked": (_linked("unlink"), f"{_PAIR_SQL} WHERE NOT (l_orderkey = 1 AND l_partkey = 1)"),
}

_ALL = PLANS | STORES


def queries() -> dict[str, Callable]:
    return {n: q for n, (q, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, sql) in _ALL.items()}
