"""A domain over the driver's star-schema tables, and the registered queries with their SQL.

Write queries work on copies of small tables in a store of their own, under the folder
named by spark.checkpoint.dir.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .design import build, plan, schema, seed
from .engine import Engine
from .functions.actions import Actions
from .model import mapping as maps
from .model import ontology as onto
from .plans.validate import validate
from .sources.catalog import ParquetCatalog
from .sources.inserts import read as read_inserts
from .sources.store import Store
from .streaming.query import stream_query

#: class -> (table, key, {field: column})
CLASSES = {
    "Region": ("region", "r_regionkey", {"region_key": "r_regionkey", "name": "r_name"}),
    "Nation": ("nation", "n_nationkey", {"nation_key": "n_nationkey", "name": "n_name"}),
    "Customer": ("customer", "c_custkey", {"customer_key": "c_custkey", "name": "c_name", "balance": "c_acctbal", "segment": "c_mktsegment"}),
    "Supplier": ("supplier", "s_suppkey", {"supplier_key": "s_suppkey", "name": "s_name", "balance": "s_acctbal"}),
    "Part": ("part", "p_partkey", {"part_key": "p_partkey", "name": "p_name", "brand": "p_brand", "kind": "p_type", "size": "p_size", "price": "p_retailprice"}),
    "Order": ("orders", "o_orderkey", {"order_key": "o_orderkey", "status": "o_orderstatus", "total": "o_totalprice", "ordered_at": "o_orderdate", "priority": "o_orderpriority"}),
    "LineItem": ("lineitem", "l_orderkey", {"line_number": "l_linenumber", "quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "return_flag": "l_returnflag", "line_status": "l_linestatus", "shipped_at": "l_shipdate"}),
    "Event": ("events", "event_id", {"event_key": "event_id", "kind": "event_type", "value": "value", "at": "ts"}),
    "Document": ("documents", "doc_id", {"document_key": "doc_id", "language": "lang", "source": "source", "length": "n_chars"}),
    "Label": ("labels", "doc_id", {"quality": "quality", "toxic": "toxic"}),
}
#: relation -> (key table, key column, table, column)
DIRECT = {
    "inRegion": ("nation", "n_regionkey", "region", "r_regionkey"),
    "customerNation": ("customer", "c_nationkey", "nation", "n_nationkey"),
    "supplierNation": ("supplier", "s_nationkey", "nation", "n_nationkey"),
    "placedBy": ("orders", "o_custkey", "customer", "c_custkey"),
    "lineOfOrder": ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    "linePart": ("lineitem", "l_partkey", "part", "p_partkey"),
    "lineSupplier": ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    "eventUser": ("events", "user_id", "customer", "c_custkey"),
    "labelOf": ("labels", "doc_id", "documents", "doc_id"),
}
MONEY = "decimal(12,2)"
CASTS = {
    "customer": {"c_acctbal": MONEY},
    "supplier": {"s_acctbal": MONEY},
    "part": {"p_retailprice": MONEY},
    "orders": {"o_totalprice": MONEY},
    "lineitem": dict.fromkeys(("l_quantity", "l_extendedprice", "l_discount", "l_tax"), MONEY),
    "events": {"value": MONEY},
}


def star_mapping() -> maps.Mapping:
    step = lambda s: dict(zip(("fk_table", "fk_column", "ref_table", "ref_column"), s, strict=True))
    relations = {n: {"type": "direct", **step(s)} for n, s in DIRECT.items()}
    relations["suppliedBy"] = {"type": "junction", "junction_table": "lineitem", "steps": [step(DIRECT["linePart"]), step(DIRECT["lineSupplier"])]}
    return maps.from_dict({"tables": {c: {"table": t, "primary_key": k, "columns": f} for c, (t, k, f) in CLASSES.items()}, "relations": relations})


def star_engine(spark: SparkSession, sf_dir: str) -> Engine:
    mapping = star_mapping()
    return Engine(spark, mapping, ParquetCatalog(spark, sf_dir, CASTS), owned=maps.ownership(mapping, "Customer"))


def _plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, which compare alike everywhere."""
    return df.withColumns({f.name: F.col(f.name).cast("double") for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)})


def _read(identity=None, **op) -> Callable:
    return lambda spark, sf_dir: _plain(star_engine(spark, sf_dir).frame({"op": "query", **op}, identity))


def _hop(rel: str, entity: str, **filters) -> dict:
    return {"rel": rel, "entity": entity, "filters": filters}


def _sum(column: str) -> str:
    return f"CAST(sum(CAST({column} AS DECIMAL(12,2))) AS DOUBLE)"


_M = lambda c: f"CAST(CAST({c} AS DECIMAL(12,2)) AS DOUBLE) AS {c}"
_CUSTOMER = f"c_custkey, c_name, c_nationkey, {_M('c_acctbal')}, c_mktsegment"
_ORDERS = f"o_orderkey, o_custkey, o_orderstatus, {_M('o_totalprice')}, o_orderdate, o_orderpriority"

READS: dict[str, tuple[Callable, str]] = {
    "q_scan_all": (_read(entity="Nation"), "SELECT * FROM nation"),
    "q_fields": (_read(entity="Customer", fields=["name", "segment", "balance"]), f"SELECT c_name, c_mktsegment, {_M('c_acctbal')} FROM customer"),
    "q_filter_one": (_read(entity="Order", filters={"status": "F"}), f"SELECT {_ORDERS} FROM orders WHERE o_orderstatus = 'F'"),
    "q_filter_and": (_read(entity="LineItem", filters={"return_flag": "R", "line_number": 3}, fields=["quantity", "line_status", "shipped_at"]), f"SELECT {_M('l_quantity')}, l_linestatus, l_shipdate FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 3"),
    "q_filter_null": (_read(entity="Order", filters={"status": None}, fields=["order_key"]), "SELECT o_orderkey FROM orders WHERE o_orderstatus = NULL"),
    "q_filter_ts": (_read(entity="Order", filters={"ordered_at": "1995-03-15"}, fields=["order_key", "ordered_at"]), "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate = TIMESTAMP '1995-03-15'"),
    "q_join_from_fk": (_read(entity="Order", filters={"status": "F"}, relations=[_hop("placedBy", "Customer", segment="BUILDING")], fields=["order_key", "total"]), f"SELECT o_orderkey, {_M('o_totalprice')} FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND c_mktsegment = 'BUILDING'"),
    "q_join_from_pk": (_read(entity="Customer", relations=[_hop("placedBy", "Order", status="F")], fields=["customer_key", "name"]), "SELECT c_custkey, c_name FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F'"),
    "q_join_unfiltered": (_read(entity="Customer", relations=[{"rel": "placedBy", "entity": "Order"}], fields=["customer_key"]), "SELECT c_custkey FROM customer JOIN orders ON o_custkey = c_custkey"),
    "q_join_two_rel": (_read(entity="LineItem", relations=[_hop("lineOfOrder", "Order", status="F"), _hop("linePart", "Part", size=10)], fields=["line_number", "quantity"]), f"SELECT l_linenumber, {_M('l_quantity')} FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderstatus = 'F' AND p_size = 10"),
    "q_join_chain3": (_read(entity="Customer", relations=[{"rel": "customerNation", "entity": "Nation"}, _hop("inRegion", "Region", name="ASIA")]), f"SELECT {_CUSTOMER} FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'"),
    "q_join_same_table_twice": (
        _read(entity="LineItem", relations=[{"rel": "lineSupplier", "entity": "Supplier"}, _hop("supplierNation", "Nation", nation_key=3), {"rel": "lineOfOrder", "entity": "Order"}, {"rel": "placedBy", "entity": "Customer"}, _hop("customerNation", "Nation", nation_key=5)], fields=["line_number", "shipped_at"]),
        "SELECT l_linenumber, l_shipdate FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey = 3 AND c_nationkey = 5",
    ),
    "q_junction_ab": (_read(entity="Part", relations=[_hop("suppliedBy", "Supplier", supplier_key=7)], fields=["part_key", "name"]), "SELECT p_partkey, p_name FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_suppkey = 7"),
    "q_junction_ba": (_read(entity="Supplier", relations=[_hop("suppliedBy", "Part", size=15)], fields=["supplier_key", "name"]), "SELECT s_suppkey, s_name FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE p_size = 15"),
    "q_count": (_read(entity="Order", aggregate={"fn": "count"}), "SELECT count(*) AS count FROM orders"),
    "q_count_field": (_read(entity="Order", aggregate={"fn": "count", "field": "priority"}), "SELECT count(o_orderpriority) AS count FROM orders"),
    "q_sum": (_read(entity="LineItem", aggregate={"fn": "sum", "field": "price"}), f"SELECT {_sum('l_extendedprice')} AS sum FROM lineitem"),
    "q_avg": (_read(entity="Part", aggregate={"fn": "avg", "field": "size"}), "SELECT avg(p_size) AS avg FROM part"),
    "q_min": (_read(entity="Order", aggregate={"fn": "min", "field": "ordered_at"}), "SELECT min(o_orderdate) AS min FROM orders"),
    "q_max": (_read(entity="Customer", aggregate={"fn": "max", "field": "balance"}), "SELECT CAST(max(CAST(c_acctbal AS DECIMAL(12,2))) AS DOUBLE) AS max FROM customer"),
    "q_agg_join": (_read(entity="Order", filters={"status": "O"}, relations=[_hop("placedBy", "Customer", segment="MACHINERY")], aggregate={"fn": "sum", "field": "total"}), f"SELECT {_sum('o_totalprice')} AS sum FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' AND c_mktsegment = 'MACHINERY'"),
    "q_agg_fanout": (_read(entity="Customer", relations=[{"rel": "placedBy", "entity": "Order"}], aggregate={"fn": "count", "field": "name"}), "SELECT count(c_name) AS count FROM customer JOIN orders ON o_custkey = c_custkey"),
    "q_agg_empty": (_read(entity="Part", filters={"brand": "none such"}, aggregate={"fn": "sum", "field": "size"}), "SELECT CAST(sum(p_size) AS BIGINT) AS sum FROM part WHERE p_brand = 'none such'"),
    "q_sort_asc": (_read(entity="Customer", sort={"field": "customer_key"}, limit=25, fields=["customer_key", "name"]), "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey ASC NULLS LAST LIMIT 25"),
    "q_sort_desc": (_read(entity="Customer", sort={"field": "customer_key", "dir": "desc"}, limit=25, fields=["customer_key", "name"]), "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey DESC NULLS FIRST LIMIT 25"),
    "q_limit_zero": (_read(entity="Nation", limit=0), "SELECT * FROM nation"),
    "q_topk_join": (_read(entity="Order", relations=[_hop("placedBy", "Customer", segment="BUILDING")], sort={"field": "order_key", "dir": "desc"}, limit=10, fields=["order_key", "total"]), f"SELECT o_orderkey, {_M('o_totalprice')} FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' ORDER BY o_orderkey DESC NULLS FIRST LIMIT 10"),
    "q_bridge_anchor": (_read(entity="LineItem", relations=[_hop("suppliedBy", "Part", size=20)], fields=["line_number"]), "SELECT l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_size = 20"),
    "q_events_of_segment": (_read(entity="Event", filters={"kind": "click"}, relations=[_hop("eventUser", "Customer", segment="BUILDING")], fields=["event_key", "at"]), "SELECT event_id, ts FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'click' AND c_mktsegment = 'BUILDING'"),
    "q_labelled_documents": (_read(entity="Document", filters={"language": "en"}, relations=[_hop("labelOf", "Label", quality=0)], fields=["document_key", "source", "length"]), "SELECT documents.doc_id, source, n_chars FROM documents JOIN labels ON labels.doc_id = documents.doc_id WHERE lang = 'en' AND quality = 0"),
    "q_scope_anchor_pk": (_read(7, entity="Customer"), f"SELECT {_CUSTOMER} FROM customer WHERE c_custkey = 7"),
    "q_scope_anchor_fk": (_read(7, entity="Order", filters={"status": "F"}), f"SELECT {_ORDERS} FROM orders WHERE o_orderstatus = 'F' AND o_custkey = 7"),
    "q_scope_none": (_read(7, entity="Part", filters={"size": 5}, fields=["part_key"]), "SELECT p_partkey FROM part WHERE p_size = 5"),
    "q_scope_agg": (_read(7, entity="Order", aggregate={"fn": "sum", "field": "total"}), f"SELECT {_sum('o_totalprice')} AS sum FROM orders WHERE o_custkey = 7"),
    "q_identities": (lambda spark, sf_dir: star_engine(spark, sf_dir).identities("Customer").select("c_custkey", "c_name"), "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 20"),
}


# writes

_folders: list[str] = []


def _root(spark: SparkSession, label: str) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        if not _folders:
            _folders.append(tempfile.mkdtemp(prefix="weftline-store-"))
            atexit.register(shutil.rmtree, _folders[0], True)
        shared = f"file://{_folders[0]}"
    return f"{shared.rstrip('/')}/store-{label}-{uuid.uuid4().hex}"


_KEYS = {"nation": "n_nationkey", "region": "r_regionkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}


def _store_engine(spark: SparkSession, sf_dir: str, *tables: str) -> Engine:
    """An engine over a store with copies of tables and the links between them as constraints."""
    store = Store(spark, _root(spark, "star"))
    catalog = ParquetCatalog(spark, sf_dir, CASTS)
    for t in tables:
        foreign = [[s[1], s[2], s[3]] for s in DIRECT.values() if s[0] == t and s[2] in tables]
        store.load(t, catalog.table(t), _KEYS[t], {"not_null": [_KEYS[t]], "unique": [_KEYS[t]], "foreign": foreign})
    mapping = star_mapping()
    return Engine(spark, mapping, store, owned=maps.ownership(mapping, "Customer"))


def _written(tables: tuple, batch: list[dict], show: str, identity=None, refused: str = "") -> Callable:
    """Run a batch on a store; ``show`` is a table's state, or ``returned`` for the rows of the last operation.

    ``refused``: why the batch must fail.
    """

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = _store_engine(spark, sf_dir, *tables)
        result = engine.execute(batch, identity)
        if result.ok == bool(refused) or refused not in result.text:
            raise RuntimeError(f"not as it should be: {result.text}")
        if show == "returned":
            return _plain(result.log[-1]["frame"])
        return _plain(engine.source.table(show))

    return run


_NEW = {"op": "create", "entity": "Order", "data": {"status": "P", "total": 12.5, "ordered_at": "2001-02-03", "priority": "2-HIGH"}}
_NEW_SQL = "SELECT (SELECT max(o_orderkey) + 1 FROM orders) AS o_orderkey, {key} AS o_custkey, 'P' AS o_orderstatus, CAST(12.5 AS DOUBLE) AS o_totalprice, TIMESTAMP '2001-02-03' AS o_orderdate, '2-HIGH' AS o_orderpriority"
_LOOKUP = {"resolve": {"placedBy": {"entity": "Customer", "filters": {"segment": "BUILDING"}}}}
_SUPPLIER = f"s_suppkey, s_name, s_nationkey, {_M('s_acctbal')}"

WRITES: dict[str, tuple[Callable, str]] = {
    "w_create_row": (_written(("region",), [{"op": "create", "entity": "Region", "data": {"name": "OCEANIA"}}], "region"), "SELECT * FROM region UNION ALL SELECT max(r_regionkey) + 1, 'OCEANIA' FROM region"),
    "w_create_resolve": (_written(("customer", "orders"), [_NEW | _LOOKUP], "returned"), _NEW_SQL.format(key="(SELECT min(c_custkey) FROM customer WHERE c_mktsegment = 'BUILDING')")),
    "w_create_scoped": (_written(("customer", "orders"), [_NEW | _LOOKUP], "returned", 9), _NEW_SQL.format(key="CAST(9 AS BIGINT)")),
    "w_update_returned": (_written(("supplier",), [{"op": "update", "entity": "Supplier", "filters": {"supplier_key": 4}, "data": {"balance": "10.25"}}], "returned"), "SELECT s_suppkey, s_name, s_nationkey, CAST(10.25 AS DOUBLE) AS s_acctbal FROM supplier WHERE s_suppkey = 4"),
    "w_update_state": (_written(("customer",), [{"op": "update", "entity": "Customer", "filters": {"segment": "BUILDING"}, "data": {"segment": "BUILT", "balance": 1}}], "customer"), "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0::DOUBLE ELSE CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS DOUBLE) END AS c_acctbal, CASE WHEN c_mktsegment = 'BUILDING' THEN 'BUILT' ELSE c_mktsegment END AS c_mktsegment FROM customer"),
    "w_update_scoped": (_written(("customer", "orders"), [{"op": "update", "entity": "Order", "data": {"priority": "none"}}], "orders", 7), _ORDERS.replace("o_orderpriority", "CASE WHEN o_custkey = 7 THEN 'none' ELSE o_orderpriority END AS o_orderpriority").join(["SELECT ", " FROM orders"])),
    "w_update_all": (_written(("region",), [{"op": "update", "entity": "Region", "data": {"name": "X"}}], "region"), "SELECT r_regionkey, 'X' AS r_name FROM region"),
    "w_delete_returned": (_written(("customer",), [{"op": "delete", "entity": "Customer", "filters": {"segment": "AUTOMOBILE"}}], "returned"), f"SELECT {_CUSTOMER} FROM customer WHERE c_mktsegment = 'AUTOMOBILE'"),
    "w_delete_state": (_written(("customer",), [{"op": "delete", "entity": "Customer", "filters": {"segment": "AUTOMOBILE"}}], "customer"), f"SELECT {_CUSTOMER} FROM customer WHERE c_mktsegment <> 'AUTOMOBILE' OR c_mktsegment IS NULL"),
    "w_delete_refused": (_written(("nation", "supplier"), [{"op": "delete", "entity": "Nation"}], "nation", refused="supplier.s_nationkey still refers to nation.n_nationkey"), "SELECT * FROM nation"),
    "b_batch_commit": (
        _written(("nation", "supplier"), [{"op": "update", "entity": "Supplier", "filters": {"supplier_key": 1}, "data": {"name": "one"}}, {"op": "update", "entity": "Supplier", "filters": {"name": "one"}, "data": {"balance": 5}}, {"op": "delete", "entity": "Supplier", "filters": {"supplier_key": 2}}], "supplier"),
        f"SELECT {_SUPPLIER} FROM supplier WHERE s_suppkey NOT IN (1, 2) UNION ALL SELECT s_suppkey, 'one', s_nationkey, 5.0 FROM supplier WHERE s_suppkey = 1",
    ),
    "b_batch_rollback": (_written(("nation", "supplier"), [{"op": "delete", "entity": "Supplier"}, {"op": "update", "entity": "Nation", "data": {"nation_key": 1}}], "supplier", refused="nation.n_nationkey must be unique"), f"SELECT {_SUPPLIER} FROM supplier"),
}


# links, actions, errors and design, on small fixtures

ONTOLOGY = """
@prefix owl: <http://www.w3.org/2002/07/owl#> .
@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
@prefix lib: <https://example.org/library#> .
lib:Branch a owl:Class ; rdfs:comment "A library branch." .
lib:Book a owl:Class ; rdfs:comment "A book on a shelf." .
lib:Author a owl:Class ; rdfs:comment "Someone who writes." .
lib:GenreValue a owl:Class ; owl:oneOf ( lib:novel lib:short_story lib:poetry ) .
lib:heldAt a owl:ObjectProperty ; rdfs:domain lib:Book ; rdfs:range lib:Branch .
lib:writtenBy a owl:ObjectProperty ; rdfs:comment "Many-to-many: a book has authors." ; rdfs:domain lib:Book ; rdfs:range lib:Author .
lib:branchName a owl:DatatypeProperty ; rdfs:domain lib:Branch ; rdfs:range xsd:string .
lib:title a owl:DatatypeProperty ; rdfs:domain lib:Book ; rdfs:range xsd:string .
lib:pages a owl:DatatypeProperty ; rdfs:domain lib:Book ; rdfs:range xsd:integer .
lib:genre a owl:DatatypeProperty ; rdfs:domain lib:Book ; rdfs:range lib:GenreValue .
lib:fullName a owl:DatatypeProperty ; rdfs:domain lib:Author ; rdfs:range xsd:string .
"""


def library() -> tuple:
    """(ontology, plan, schema, mapping) of the small example domain."""
    o = onto.parse(ONTOLOGY)
    p = plan.design(o)
    s = schema.reconcile(p, build.build(p, o), o)
    return o, p, s, maps.from_dict(maps.from_schema(s, o), o)


def library_engine(spark: SparkSession, actions: Actions | None = None) -> Engine:
    _, _, s, m = library()
    store = Store(spark, _root(spark, "library"))
    store.create(schema.store_tables(s))
    seed.fill(store, s, rows=3, pairs=4)
    return Engine(spark, m, store, actions)


def _pairs(batch: list[dict]) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = library_engine(spark)
        engine.execute(batch)
        return engine.source.table("lib_book_authors").select("lib_book_id", "lib_author_id")

    return run


def _join(op: str, book: int, author: int) -> dict:
    return {"op": op, "relation": "writtenBy", "from": {"entity": "Book", "filters": {"title": f"title {book}"}}, "to": {"entity": "Author", "filters": {"full_name": f"full name {author}"}}}


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping, q = library()[3], {"op": "query", "entity": "Book"}
    cases = {
        "no op": {},
        "unknown entity": {"op": "query", "entity": "Film"},
        "unknown field": q | {"fields": ["isbn"], "filters": {"colour": 1}},
        "unknown relation": q | {"relations": [{"rel": "filmedBy", "entity": "Author"}]},
        "unrelated entity": q | {"relations": [{"rel": "heldAt", "entity": "Author"}]},
        "resolve through junction": {"op": "create", "entity": "Book", "data": {"title": "x"}, "resolve": {"writtenBy": {"entity": "Author", "filters": {}}}},
        "bad aggregate": q | {"aggregate": {"fn": "median", "field": "pages"}},
        "sum without field": q | {"aggregate": {"fn": "sum"}},
        "bad sort": q | {"sort": {"field": "pages", "dir": "ASC"}},
        "unknown action": {"op": "action", "action": "scan"},
        "link by key": {"op": "link", "relation": "heldAt", "from": {}, "to": {}},
        "link without filters": {"op": "link", "relation": "writtenBy", "from": {"entity": "Book", "filters": {}}, "to": {"entity": "Author", "filters": {"full_name": "x"}}},
        "fine": q,
    }
    return spark.createDataFrame([(n, len(validate([op], mapping))) for n, op in cases.items()], "name string, errors int")


def _action(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = Actions()
    actions.register("count_pages", lambda params, context, mapping: context.table("lib_books").where(F.col("genre") == params["genre"]).count())
    engine = library_engine(spark, actions)
    out = engine.execute([{"op": "update", "entity": "Book", "data": {"genre": "poetry"}}, {"op": "action", "action": "count_pages", "params": {"genre": "poetry"}}])
    return spark.createDataFrame([(out.log[-1]["result"], out.ok)], "result string, ok boolean")


def _ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = library()[2]
    rows = [(t["name"], f.name, f.dataType.simpleString()) for t in schema.store_tables(s) for f in t["schema"].fields if f.name != "created_at"]
    return spark.createDataFrame(rows, "table_name string, column_name string, type string")


def _insert_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "-- rows\nINSERT INTO t (a, b) VALUES (1, 'it''s; (fine)'), (2, NULL);\nINSERT INTO t (a, b) VALUES (3, 'x');"
    return spark.createDataFrame([(int(r[0]), r[1]) for i in read_inserts(text) for r in i.rows], "a int, b string")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that a streaming anchor has given once all files are read."""
    catalog = ParquetCatalog(spark, sf_dir, CASTS)
    kind = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    anchor = spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    op = {"op": "query", "entity": "Event", "filters": {"kind": "purchase"}, "relations": [_hop("eventUser", "Customer", segment="BUILDING")], "fields": ["event_key", "at"]}
    out = stream_query(op, star_mapping(), anchor, catalog)
    root = _root(spark, "stream")
    query = out.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start(f"{root}/rows")
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/rows")


OTHERS: dict[str, tuple[Callable, str]] = {
    "w_link_state": (_pairs([_join("link", 3, 3)]), "SELECT * FROM (VALUES (1, 1), (1, 2), (1, 3), (2, 1), (3, 3)) AS t(lib_book_id, lib_author_id)"),
    "w_link_twice": (_pairs([_join("link", 3, 3), _join("link", 3, 3), _join("link", 1, 2)]), "SELECT * FROM (VALUES (1, 1), (1, 2), (1, 3), (2, 1), (3, 3)) AS t(lib_book_id, lib_author_id)"),
    "w_unlink_state": (_pairs([_join("unlink", 1, 2), _join("unlink", 2, 2)]), "SELECT * FROM (VALUES (1, 1), (1, 3), (2, 1)) AS t(lib_book_id, lib_author_id)"),
    "v_errors": (_errors, "SELECT * FROM (VALUES ('no op', 1), ('unknown entity', 1), ('unknown field', 2), ('unknown relation', 1), ('unrelated entity', 1), ('resolve through junction', 1), ('bad aggregate', 1), ('sum without field', 1), ('bad sort', 1), ('unknown action', 1), ('link by key', 1), ('link without filters', 1), ('fine', 0)) AS t(name, errors)"),
    "x_action": (_action, "SELECT '3' AS result, true AS ok"),
    "d_plan_tables": (lambda spark, sf_dir: spark.createDataFrame([(t["name"], t["primary_key"]) for t in library()[1]["tables"]], "name string, primary_key string"), "SELECT * FROM (VALUES ('lib_authors', 'lib_author_id'), ('lib_books', 'lib_book_id'), ('lib_branches', 'lib_branch_id')) AS t(name, primary_key)".replace("lib_branches", "lib_branchs")),
    "d_plan_order": (lambda spark, sf_dir: spark.createDataFrame([(t, o["level"]) for o in library()[1]["creation_order"] for t in o["tables"]], "name string, level int"), "SELECT * FROM (VALUES ('lib_authors', 0), ('lib_branchs', 0), ('lib_books', 1)) AS t(name, level)"),
    "d_ddl": (_ddl, "SELECT * FROM (VALUES ('lib_genre_values', 'code', 'string'), ('lib_genre_values', 'label', 'string'), ('lib_genre_values', 'sort_order', 'int'), ('lib_genre_values', 'active', 'boolean'), ('lib_authors', 'lib_author_id', 'int'), ('lib_authors', 'full_name', 'string'), ('lib_branchs', 'lib_branch_id', 'int'), ('lib_branchs', 'branch_name', 'string'), ('lib_books', 'lib_book_id', 'int'), ('lib_books', 'lib_branch_id', 'int'), ('lib_books', 'genre', 'string'), ('lib_books', 'pages', 'int'), ('lib_books', 'title', 'string'), ('lib_book_authors', 'lib_book_authors_id', 'int'), ('lib_book_authors', 'lib_book_id', 'int'), ('lib_book_authors', 'lib_author_id', 'int')) AS t(table_name, column_name, type)"),
    "d_lookup_seed": (lambda spark, sf_dir: seed.lookup_rows(spark, library()[2]["tables"][0]), "SELECT * FROM (VALUES ('novel', 'Novel', 1, true), ('short_story', 'Short Story', 2, true), ('poetry', 'Poetry', 3, true)) AS t(code, label, sort_order, active)"),
    "d_junction_seed": (lambda spark, sf_dir: seed.junction_rows(spark, library()[2]["tables"][-1], 3, 4), "SELECT * FROM (VALUES (1, 1, 1), (2, 1, 2), (3, 1, 3), (4, 2, 1)) AS t(lib_book_authors_id, lib_book_id, lib_author_id)"),
    "s_insert_text": (_insert_text, "SELECT * FROM (VALUES (1, 'it''s; (fine)'), (2, NULL), (3, 'x')) AS t(a, b)"),
    "s_stream_anchor": (_stream, "SELECT event_id, ts FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'purchase' AND c_mktsegment = 'BUILDING'"),
}

_ALL = READS | WRITES | OTHERS


def queries() -> dict[str, Callable]:
    return {n: q for n, (q, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, sql) in _ALL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a segment's customers by key, scoped and joined through the mapping."""
    return READS["q_topk_join"][0](spark, sf_dir)
