"""Registered queries over stores of the star-schema tables, and their SQL.

Each loads whole tables into a store, in several files by ranges of a key, works on it by operations, and shows what it then holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .design import seed
from .engine import Engine
from .errors import ConstraintViolation, StoreError
from .functions.actions import Actions
from .model import mapping as maps
from .sources.catalog import ParquetCatalog
from .sources.store import Store
from .star import _CUSTOMER, _KEYS, _M, _ORDERS, CASTS, DIRECT, _hop, _plain, _root, star_mapping

_LINES = f"l_orderkey, l_partkey, l_suppkey, l_linenumber, {_M('l_quantity')}, {_M('l_extendedprice')}, {_M('l_discount')}, {_M('l_tax')}, l_returnflag, l_linestatus, l_shipdate"
#: By which column a table's files are cut.
RANGES = {"lineitem": "l_orderkey"} | _KEYS
FILES = 8


def ranged_store(spark: SparkSession, sf_dir: str, *tables: str) -> Store:
    """Tables in files by ranges of a key, with the keys between them as constraints."""
    store, catalog = Store(spark, _root(spark, "ranged")), ParquetCatalog(spark, sf_dir, CASTS)
    for t in tables:
        foreign = [[s[1], s[2], s[3]] for s in DIRECT.values() if s[0] == t and s[2] in tables]
        key = _KEYS.get(t)
        rules = {"not_null": [c for c in {key, *(f[0] for f in foreign)} if c], "unique": [key] if key else [], "foreign": foreign}
        store.load(t, catalog.table(t).repartitionByRange(FILES, RANGES[t]), key, rules)
    return store


def ranged_engine(spark: SparkSession, store: Store, actions: Actions | None = None) -> Engine:
    m = star_mapping()
    return Engine(spark, m, store, actions, owned=maps.ownership(m, "Customer"), paths=maps.owner_paths(m, "Customer"))


def _run(engine: Engine, batch: list[dict], identity=None, refused: str = "") -> None:
    """A batch whose rows nobody asks for: they stay where they are, and text is made of a failure only."""
    result = engine.execute(batch, identity, lazy=True)
    if result.ok == bool(refused) or refused and refused not in result.text:
        raise RuntimeError("a batch that must fail did not" if result.ok else f"not as it should be: {result.text}")


def _after(tables: tuple, batches: list[list[dict]], show: str, identity=None, compact: bool = False) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = ranged_store(spark, sf_dir, *tables)
        engine = ranged_engine(spark, store)
        for batch in batches:
            _run(engine, batch, identity)
        if compact:
            store.compact(show)
        return _plain(store.table(show))

    return run


def _asked(tables: tuple, op: dict, identity=None) -> Callable:
    return lambda spark, sf_dir: _plain(ranged_engine(spark, ranged_store(spark, sf_dir, *tables)).frame({"op": "query", **op}, identity))


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders loaded unchecked beside the customers of one segment: a join without filters still drops those of others."""
    store, catalog = Store(spark, _root(spark, "orphans")), ParquetCatalog(spark, sf_dir, CASTS)
    customers = catalog.table("customer").where("c_mktsegment = 'BUILDING'")
    store.load("customer", customers, "c_custkey", {"not_null": ["c_custkey"], "unique": ["c_custkey"]})
    rules = {"not_null": ["o_orderkey", "o_custkey"], "unique": ["o_orderkey"], "foreign": [["o_custkey", "customer", "c_custkey"]]}
    try:
        store.load("orders", catalog.table("orders"), "o_orderkey", rules)
        raise RuntimeError("orphans were loaded")
    except ConstraintViolation:
        store.load("orders", catalog.table("orders"), "o_orderkey", rules, check=False)
    return ranged_engine(spark, store).frame({"op": "query", "entity": "Order", "relations": [{"rel": "placedBy", "entity": "Customer"}], "fields": ["order_key"]})


def _raise_prices(params: dict, context, mapping) -> str:
    """Marks the orders of a status; a nested attempt that fails leaves nothing."""
    done = context.execute([{"op": "update", "entity": "Order", "filters": {"status": params["status"]}, "data": {"priority": "late"}}])
    try:
        with context.savepoint():
            context.execute([{"op": "delete", "entity": "Order", "filters": {"status": "O"}}])
            context.execute([{"op": "update", "entity": "Customer", "filters": {"segment": "BUILDING"}, "data": {"customer_key": 1}}])
    except ConstraintViolation:
        pass
    return str(done[0]["result"]["rows_affected"])


def _acted(then: list[dict], refused: str = "") -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        actions = Actions()
        actions.register("mark_late", _raise_prices)
        store = ranged_store(spark, sf_dir, "customer", "orders")
        _run(ranged_engine(spark, store, actions), [{"op": "action", "action": "mark_late", "params": {"status": "F"}}, *then], refused=refused)
        return _plain(store.table("orders"))

    return run


def _link_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of 40 links and 20 unlinks between parts and suppliers."""
    store = ranged_store(spark, sf_dir, "part", "supplier", "lineitem")
    link = lambda op, i: {"op": op, "relation": "suppliedBy", "from": {"entity": "Part", "filters": {"part_key": i}}, "to": {"entity": "Supplier", "filters": {"supplier_key": i % 10}}}
    _run(ranged_engine(spark, store), [*(link("link", i) for i in range(40)), *(link("unlink", i) for i in range(0, 40, 2))])
    return store.table("lineitem").select("l_partkey", "l_suppkey")


def _two_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writers of different files both commit; a third that read what they wrote doesn't."""
    store = ranged_store(spark, sf_dir, "customer")
    low, high = store.table("customer").agg(F.min("c_custkey"), F.max("c_custkey")).first()
    one, two, three = (store.transaction() for _ in range(3))
    for tx, key in ((one, low), (two, high), (three, low)):
        tx.change("customer", F.col("c_custkey") == key, {"c_name": F.lit(f"writer {key}")}, {"c_custkey": key})
    one.commit()
    two.commit()
    try:
        three.commit()
        raise RuntimeError("a lost update")
    except StoreError:
        return _plain(store.table("customer"))


def insert_text(df: DataFrame, table: str, path: str, every: int = 1000) -> None:
    """A table as INSERT statements of ``every`` rows, a row a line, in text files."""
    literal = lambda f: F.coalesce(F.concat(F.lit("'"), F.replace(F.col(f.name).cast("string"), F.lit("'"), F.lit("''")), F.lit("'")) if not isinstance(f.dataType, T.NumericType) else F.col(f.name).cast("string"), F.lit("NULL"))
    row = F.concat(F.lit("("), F.concat_ws(", ", *[literal(f) for f in df.schema.fields]), F.lit(")"))
    head = F.lit(f"INSERT INTO {table} ({', '.join(df.columns)}) VALUES\n")
    place = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    lines = df.withColumn("_place", F.monotonically_increasing_id()).select(F.when(place == 0, F.concat(head, row)).when(place % every == 0, F.concat(F.lit(";\n"), head, row)).otherwise(F.concat(F.lit(", "), row)))
    lines.write.text(path)


def _from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem written as INSERT text and loaded from it."""
    lines = ParquetCatalog(spark, sf_dir, CASTS).table("lineitem")
    root = _root(spark, "text")
    insert_text(lines.repartitionByRange(FILES, "l_orderkey"), "lineitem", f"{root}/text")
    store = Store(spark, f"{root}/store")
    store.create([{"name": "lineitem", "schema": lines.schema, "constraints": {"not_null": ["l_orderkey"]}}])
    seed.load_insert_files(store, f"{root}/text")
    return _plain(store.table("lineitem"))


_SEVEN = "EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_custkey = 7)"
_LATE = "CASE WHEN o_orderstatus = 'F' THEN 'late' ELSE o_orderpriority END AS o_orderpriority"
_STATUS = f"CASE WHEN {_SEVEN} THEN 'Z' ELSE l_linestatus END AS l_linestatus"
_WRITER = "CASE WHEN c_custkey IN (SELECT min(c_custkey) FROM customer UNION ALL SELECT max(c_custkey) FROM customer) THEN 'writer ' || c_custkey ELSE c_name END AS c_name"
_THIRD = {"op": "update", "entity": "LineItem", "filters": {"return_flag": "R", "line_number": 3}, "data": {"line_status": "Z", "discount": 0.5}}
_GONE = {"op": "delete", "entity": "LineItem", "filters": {"return_flag": "A", "line_number": 1}}
_CHANGED = _LINES.replace(_M("l_discount"), "CASE WHEN l_returnflag = 'R' AND l_linenumber = 3 THEN 0.5::DOUBLE ELSE CAST(CAST(l_discount AS DECIMAL(12,2)) AS DOUBLE) END AS l_discount").replace("l_linestatus", "CASE WHEN l_returnflag = 'R' AND l_linenumber = 3 THEN 'Z' ELSE l_linestatus END AS l_linestatus")
_LEFT = "NOT (l_returnflag = 'A' AND l_linenumber = 1)"

STORES: dict[str, tuple[Callable, str]] = {
    "w_update_marks": (_after(("lineitem",), [[_THIRD], [_THIRD]], "lineitem"), f"SELECT {_CHANGED} FROM lineitem"),
    "w_delete_marks": (_after(("lineitem",), [[_GONE], [_THIRD]], "lineitem"), f"SELECT {_CHANGED} FROM lineitem WHERE {_LEFT}"),
    "w_compacted": (_after(("lineitem",), [[_GONE], [_THIRD]], "lineitem", compact=True), f"SELECT {_CHANGED} FROM lineitem WHERE {_LEFT}"),
    "q_store_lookup": (_asked(("orders",), {"entity": "Order", "filters": {"order_key": 77}}), f"SELECT {_ORDERS} FROM orders WHERE o_orderkey = 77"),
    "q_store_count": (_asked(("orders",), {"entity": "Order", "aggregate": {"fn": "count"}}), "SELECT count(*) AS count FROM orders"),
    "q_store_min": (_asked(("orders",), {"entity": "Order", "aggregate": {"fn": "min", "field": "ordered_at"}}), "SELECT min(o_orderdate) AS min FROM orders"),
    "q_store_max": (_asked(("customer",), {"entity": "Customer", "aggregate": {"fn": "max", "field": "balance"}}), "SELECT CAST(max(CAST(c_acctbal AS DECIMAL(12,2))) AS DOUBLE) AS max FROM customer"),
    "q_store_orphans": (_orphans, "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'"),
    "q_store_join": (_asked(("customer", "orders"), {"entity": "Order", "relations": [_hop("placedBy", "Customer", segment="BUILDING")], "fields": ["order_key"]}), "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'"),
    "q_scope_two_hops": (_asked(("orders", "lineitem"), {"entity": "LineItem", "filters": {"return_flag": "R"}}, 7), f"SELECT {_LINES} FROM lineitem WHERE l_returnflag = 'R' AND {_SEVEN}"),
    "q_scope_two_hops_agg": (_asked(("orders", "lineitem"), {"entity": "LineItem", "aggregate": {"fn": "count"}}, 7), f"SELECT count(*) AS count FROM lineitem WHERE {_SEVEN}"),
    "w_update_two_hops": (_after(("orders", "lineitem"), [[{"op": "update", "entity": "LineItem", "data": {"line_status": "Z"}}]], "lineitem", 7), f"SELECT {_LINES.replace('l_linestatus', _STATUS)} FROM lineitem"),
    "w_delete_two_hops": (_after(("orders", "lineitem"), [[{"op": "delete", "entity": "LineItem", "filters": {"return_flag": "N"}}]], "lineitem", 7), f"SELECT {_LINES} FROM lineitem WHERE NOT (l_returnflag = 'N' AND {_SEVEN})"),
    "x_action_writes": (_acted([]), f"SELECT {_ORDERS.replace('o_orderpriority', _LATE)} FROM orders"),
    "x_action_undone": (_acted([{"op": "update", "entity": "Customer", "data": {"customer_key": 1}}], refused="customer.c_custkey must be unique"), f"SELECT {_ORDERS} FROM orders"),
    "w_link_runs": (
        _link_runs,
        "SELECT l_partkey, l_suppkey FROM lineitem WHERE NOT (l_partkey < 40 AND l_partkey % 2 = 0 AND l_suppkey = l_partkey % 10) UNION ALL SELECT i, i % 10 FROM range(1, 40, 2) AS t(i) WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = i AND l_suppkey = i % 10)",
    ),
    "i_text_at_scale": (_from_text, f"SELECT {_LINES} FROM lineitem"),
    "b_two_writers": (_two_writers, f"SELECT {_CUSTOMER.replace('c_name', _WRITER)} FROM customer"),
}


def queries() -> dict[str, Callable]:
    return {n: q for n, (q, _) in STORES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, sql) in STORES.items()}
