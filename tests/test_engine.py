import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from weftline import domain
from weftline.design import schema, seed
from weftline.engine import Engine
from weftline.errors import StoreError
from weftline.functions.actions import Actions
from weftline.model import mapping as maps
from weftline.plans.compile import Compiler, Trust
from weftline.plans.operations import parse
from weftline.sources.catalog import JdbcCatalog, JdbcTables, ParquetCatalog, SessionCatalog
from weftline.sources.store import Store
from weftline.star import CASTS, library, star_engine, star_mapping
from weftline.streaming.query import stream_query

SF = "/root/testdata/sf0.001"


@pytest.fixture
def engine(spark, tmp_path):
    _, _, s, m = library()
    store = Store(spark, str(tmp_path / "store"))
    store.create(schema.store_tables(s))
    seed.fill(store, s, rows=3, pairs=4)
    return Engine(spark, m, store, owned=maps.ownership(m, "Branch"))


def rows(engine, table):
    return sorted(map(tuple, engine.source.table(table).drop("created_at").collect()), key=str)


def book(title="new", **data):
    return {"op": "create", "entity": "Book", "data": {"title": title, "pages": 10, "genre": "novel"} | data, "resolve": {"heldAt": {"entity": "Branch", "filters": {"branch_name": "branch name 2"}}}}


def test_create_reads_its_own_writes(engine):
    r = engine.execute([book(), {"op": "query", "entity": "Book", "filters": {"title": "new"}, "fields": ["pages"]}])
    assert r.ok
    assert r.text.endswith("\n10")
    assert json.loads(r.text.rpartition("\n")[0])[0]["lib_branch_id"] == 2
    assert r.log[0]["is_write"]


def test_a_cut_result_says_so(engine):
    ask = {"op": "query", "entity": "Book", "fields": ["title"]}
    n = engine.execute([ask]).log[0]["total"]
    assert n > 2
    for most in (n, n - 1):
        engine.max_rows = most
        r = engine.execute([ask])
        assert len(r.log[0]["result"]) == most
        assert r.log[0]["total"] == r.log[0]["frame"].count() == n
        assert (f"the first {most} of {n} rows" in r.text) == (most < n)
    r = engine.execute([{"op": "update", "entity": "Book", "data": {"pages": 7}}])
    assert r.log[0]["result"]["rows_affected"] == n
    assert f"the first {n - 1} of {n} rows" in r.text


def test_failure_rolls_everything_back(engine):
    before, version = rows(engine, "lib_books"), engine.source.version()
    r = engine.execute([book(), book(genre="opera")])
    assert not r.ok
    assert r.text.startswith("Operation 2 FAILED")
    assert "rolled back" in r.text
    assert rows(engine, "lib_books") == before
    assert engine.source.version() == version


@pytest.mark.parametrize(("batch", "says"), [
    ([book(title=None)], "must not be null"),
    ([book(title="x" * 256)], "longer than 255"),
    ([book(pages="many")], "not a value"),
    ([book() | {"resolve": {"heldAt": {"entity": "Branch", "filters": {"branch_name": "nowhere"}}}}], "must not be null"),
    ([{"op": "delete", "entity": "Branch"}], "still refers"),
    ([{"op": "update", "entity": "Book", "data": {"pages": None}}], "must not be null"),
    ([{"op": "link", "relation": "writtenBy", "from": {"entity": "Book", "filters": {"genre": "none"}}, "to": {"entity": "Author", "filters": {"full_name": "x"}}}], "no match"),
])
def test_errors_are_text(engine, batch, says):
    r = engine.execute(batch)
    assert not r.ok
    assert says in r.text


def test_ambiguous_end(engine):
    engine.execute([{"op": "update", "entity": "Book", "data": {"genre": "poetry"}}])
    r = engine.execute([{"op": "link", "relation": "writtenBy", "from": {"entity": "Book", "filters": {"genre": "poetry"}}, "to": {"entity": "Author", "filters": {"full_name": "full name 1"}}}])
    assert "ambiguous" in r.text


def test_update_and_delete_treat_null_as_no_match(engine):
    before = rows(engine, "lib_books")
    r = engine.execute([{"op": "update", "entity": "Book", "filters": {"title": None}, "data": {"pages": 1}}, {"op": "delete", "entity": "Book", "filters": {"title": None}}])
    assert r.text == "Updated 0 Book record(s).\nDeleted 0 Book record(s)."
    assert rows(engine, "lib_books") == before


def test_scope(engine):
    mine = engine.source.table("lib_books").where("lib_branch_id = 2").count()
    assert engine.execute([{"op": "query", "entity": "Book", "aggregate": {"fn": "count"}}], identity=2).text == str(mine)
    engine.execute([book("scoped") | {"resolve": {"heldAt": {"entity": "Branch", "filters": {"branch_name": "branch name 1"}}}}], identity=3)
    assert engine.source.table("lib_books").where("title = 'scoped'").first()["lib_branch_id"] == 3
    engine.execute([{"op": "update", "entity": "Book", "data": {"pages": 7}}], identity=3)
    assert engine.source.table("lib_books").where("(pages = 7) <> (lib_branch_id = 3)").count() == 0
    link = {"op": "link", "relation": "writtenBy", "from": {"entity": "Book", "filters": {"title": "scoped"}}, "to": {"entity": "Author", "filters": {"full_name": "full name 1"}}}
    assert "no match" in engine.execute([link], identity=1).text
    assert engine.execute([link], identity=3).ok


def test_duplicate_key_of_a_scoped_user(engine):
    r = engine.execute([{"op": "create", "entity": "Branch", "data": {"branch_name": "again"}}], identity=1)
    assert "must be unique" in r.text


def test_action_sees_the_batch_and_its_error_fails_it(engine):
    actions = Actions()
    actions.register("count", lambda p, c, m: c.table("lib_books").count())
    actions.register("break", lambda p, c, m: 1 / 0)
    engine.actions = actions
    n = engine.source.table("lib_books").count()
    assert engine.execute([book(), {"op": "action", "action": "count"}]).text.endswith(f"\n{n + 1}")
    r = engine.execute([book("lost"), {"op": "action", "action": "break"}])
    assert "division by zero" in r.text
    assert engine.source.table("lib_books").where("title = 'lost'").count() == 0


def test_only_touched_files_are_rewritten(engine):
    engine.execute([book("a")])
    engine.execute([book("b")])
    before = engine.source.manifest()["tables"]["lib_books"]["files"]
    engine.execute([{"op": "update", "entity": "Book", "filters": {"title": "b"}, "data": {"pages": 99}}])
    after = engine.source.manifest()["tables"]["lib_books"]["files"]
    assert len(set(before) - set(after)) == 1
    assert engine.source.table("lib_books").where("title = 'b'").first()["pages"] == 99


def test_writers_exclude_each_other(engine):
    one, two = engine.source.transaction(), engine.source.transaction()
    one.change("lib_books", F.col("title") == "title 1", None)
    two.change("lib_books", F.col("title") == "title 2", None)
    one.commit()
    with pytest.raises(StoreError, match="first"):
        two.commit()
    assert rows(engine, "lib_books")[0][0] == 2


def test_vacuum_keeps_the_current_version(engine):
    engine.execute([{"op": "update", "entity": "Book", "data": {"pages": 1}}])
    before = rows(engine, "lib_books")
    assert engine.source.vacuum() > 0
    assert rows(engine, "lib_books") == before


def test_readiness_and_drop(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert not store.ready()
    store.load("t", spark.range(3).withColumnRenamed("id", "k"), "k")
    assert store.ready()
    assert store.manifest()["tables"]["t"]["next_key"] == 3
    store.drop_tables(["t"])
    assert not store.ready()
    store.drop()
    assert store.version() == 0


def test_seed_text(spark, tmp_path):
    _, _, s, _ = library()
    store = Store(spark, str(tmp_path / "s"))
    store.create(schema.store_tables(s))
    good = "INSERT INTO lib_genre_values (code, label) VALUES ('novel', 'Novel');\nINSERT INTO lib_branchs (branch_name) VALUES ('a'), ('b');\nINSERT INTO lib_books (title, pages, genre, lib_branch_id) VALUES ('t', 3, 'novel', 2);"
    assert seed.check_inserts(store, good) == []
    assert store.table("lib_books").count() == 0
    assert seed.load_inserts(store, good) == 3
    assert store.table("lib_genre_values").first()["sort_order"] == 0
    assert "lib_branchs has no lib_branch_id 9" in seed.check_inserts(store, "INSERT INTO lib_books (title, pages, genre, lib_branch_id) VALUES ('t', 3, 'novel', 9)")[0]


def test_domain_folder(spark, tmp_path):
    from weftline.star import ONTOLOGY

    (tmp_path / "lib" / "actions").mkdir(parents=True)
    (tmp_path / "lib" / "lib.ttl").write_text(ONTOLOGY)
    (tmp_path / "lib" / "domain.json").write_text(json.dumps({"name": "Library", "ontology": "lib.ttl", "identity_entity": "Branch", "data_sources": {"primary": {"store": "lib", "source_dir": "primary"}}}))
    assert domain.available(tmp_path) == ["lib"]
    d = domain.load(tmp_path / "lib")
    made = domain.design(d)
    assert d.source().mapping.exists()
    domain.install(spark, made, str(tmp_path / "store"), rows=2)
    e = domain.engine(spark, d, str(tmp_path / "store"))
    assert e.execute([{"op": "query", "entity": "Book", "aggregate": {"fn": "count"}}]).text == "2"
    domain.update_manifest(d.folder, description="changed")
    assert domain.load(d.folder).description == "changed"
    (tmp_path / "stores.ini").write_text("[data_source:primary]\npath = /x\n")
    assert domain.store_paths(tmp_path / "stores.ini") == {"primary": "/x"}


def test_catalog_is_read_only(spark):
    assert "read-only" in star_engine(spark, SF).execute([{"op": "delete", "entity": "Region"}]).text


def test_session_catalog(spark):
    spark.range(3).selectExpr("id AS r_regionkey", "'x' AS r_name").createOrReplaceTempView("region")
    e = Engine(spark, star_mapping(), SessionCatalog(spark))
    assert e.frame({"op": "query", "entity": "Region"}).count() == 3


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan_of(star_engine(spark, SF).frame({"op": "query", "entity": "Order", "filters": {"status": "F"}, "relations": [{"rel": "placedBy", "entity": "Customer", "filters": {"segment": "BUILDING"}}], "fields": ["order_key"]}))
    assert "EqualTo(o_orderstatus,F)" in text
    assert "EqualTo(c_mktsegment,BUILDING)" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string>" in text


def test_self_relation_joins_the_referenced_side(spark):
    spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 1)], "id int, name string, boss int").createOrReplaceTempView("people")
    m = maps.from_dict({"tables": {"Person": {"table": "people", "primary_key": "id", "columns": {"name": "name"}}}, "relations": {"reportsTo": {"type": "direct", "fk_table": "people", "fk_column": "boss", "ref_table": "people", "ref_column": "id"}}})
    df = Engine(spark, m, SessionCatalog(spark)).frame({"op": "query", "entity": "Person", "relations": [{"rel": "reportsTo", "entity": "Person", "filters": {"name": "a"}}], "fields": ["name"]})
    assert sorted(r[0] for r in df.collect()) == ["b", "c"]


def test_rewrites_change_plans_and_not_rows(spark):
    m, catalog = star_mapping(), ParquetCatalog(spark, SF, CASTS)
    trust = Trust(frozenset({("orders", "o_custkey")}), frozenset({("customer", "c_custkey")}), frozenset({("orders", "o_custkey", "customer", "c_custkey")}))
    base = {"op": "query", "entity": "Order", "fields": ["order_key"]}
    for hops, joins in (([{"rel": "placedBy", "entity": "Customer"}], 0), ([{"rel": "placedBy", "entity": "Customer", "filters": {"segment": "BUILDING"}}], 1), ([{"rel": "placedBy", "entity": "Customer"}, {"rel": "customerNation", "entity": "Nation", "filters": {"nation_key": 3}}], 2)):
        op = parse(base | {"relations": hops})
        plain, trusted = Compiler(m, catalog.table).query(op), Compiler(m, catalog.table, trust=trust).query(op)
        assert sorted(plain.collect()) == sorted(trusted.collect())
        assert trusted._jdf.queryExecution().optimizedPlan().toString().count("Join ") == joins


def test_frames_and_identities(spark):
    e = star_engine(spark, SF)
    one, two = e.frames([{"op": "query", "entity": "Region"}, {"op": "query", "entity": "Nation", "aggregate": {"fn": "count"}}])
    assert (one.count(), two.first()[0]) == (5, 25)
    assert [r["c_custkey"] for r in e.identities("Customer", 3).collect()] == [0, 1, 2]


def test_deep_scope(spark):
    m, catalog = star_mapping(), ParquetCatalog(spark, SF, CASTS)
    op = {"op": "query", "entity": "LineItem", "relations": [{"rel": "lineOfOrder", "entity": "Order"}], "aggregate": {"fn": "count"}}
    owned = maps.ownership(m, "Customer")
    wide = Engine(spark, m, catalog, owned=owned).execute([op], identity=7).text
    deep = Engine(spark, m, catalog, owned=owned, deep_scope=True).execute([op], identity=7).text
    assert int(deep) < int(wide)


def test_stream_refuses_totals(spark):
    with pytest.raises(Exception, match="total"):
        stream_query({"op": "query", "entity": "Event", "aggregate": {"fn": "count"}}, star_mapping(), None, None)


def test_results_are_whole_unless_a_caller_asks_otherwise(spark):
    n = spark.read.parquet("/root/testdata/sf0.01/orders.parquet").count()
    ask = {"op": "query", "entity": "Order", "fields": ["order_key"]}
    r = star_engine(spark, "/root/testdata/sf0.01").execute([ask])
    assert n > 1000
    assert len(r.log[0]["result"]) == len(json.loads(r.text)) == r.log[0]["total"] == n
    assert "o_orderkey" in r.log[0]["plan"]


def test_lazy_results_are_the_same_text(engine):
    batch = [{"op": "query", "entity": "Book"}, {"op": "query", "entity": "Book", "filters": {"title": "none"}}, {"op": "query", "entity": "Book", "aggregate": {"fn": "count"}}, {"op": "query", "entity": "Book", "fields": ["title", "pages"], "filters": {"title": "title 1"}}, {"op": "query", "entity": "Book", "fields": ["title"]}]
    plain, lazy = engine.execute(batch), engine.execute(batch, lazy=True)
    assert lazy.text == plain.text
    assert lazy.text == lazy.text
    assert [list(e["result"]) for e in lazy.log] == [e["result"] for e in plain.log]
    assert len(lazy.log[0]["result"]) == 3
    gone = engine.execute([{"op": "update", "entity": "Book", "data": {"pages": 5}}, book("gone"), {"op": "delete", "entity": "Book", "filters": {"title": "gone"}}, {"op": "delete", "entity": "Book", "filters": {"title": "gone"}}], lazy=True)
    assert gone.ok
    assert gone.text.endswith("Deleted 0 Book record(s).")
    assert [len(list(e["result"]["returned_data"])) for e in gone.log] == [3, 1, 1, 0]
    assert not engine.execute([{"op": "query", "entity": "Film"}], lazy=True).ok


def test_a_large_result_passes_a_small_driver(spark, tmp_path):
    """All of lineitem as text, a partition at a time, by a driver of 512 MB that couldn't hold it as rows."""
    lines = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet")
    lines.repartition(32).write.parquet(str(tmp_path / "lineitem.parquet"))
    script = tmp_path / "large.py"
    script.write_text(f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parent.parent)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.driver.memory", "512m").config("spark.driver.maxResultSize", "64m").config("spark.ui.enabled", "false").config("spark.sql.files.maxPartitionBytes", "1m").getOrCreate()
from weftline.star import star_engine
r = star_engine(spark, {str(tmp_path)!r}).execute([{{"op": "query", "entity": "LineItem"}}], lazy=True)
n, size = 0, 0
for piece in r.pieces():
    n, size = n + piece.count('"l_orderkey"'), size + len(piece)
import resource
print(n, size, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
""")
    out = subprocess.run([sys.executable, str(script)], capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    n, size, most = map(int, out.stdout.split())
    assert n == lines.count()
    assert size > 100_000_000
    assert most < 512


@pytest.mark.parametrize("op", [
    {"op": [], "entity": "Book"},
    {"op": "query", "entity": []},
    {"op": "query", "entity": "Book", "fields": [{}]},
    {"op": "query", "entity": "Book", "fields": "title"},
    {"op": "query", "entity": "Book", "filters": ["title"]},
    {"op": "query", "entity": "Book", "relations": [{"rel": [], "entity": "Branch"}]},
    {"op": "query", "entity": "Book", "relations": [{"rel": "heldAt", "entity": {}}]},
    {"op": "query", "entity": "Book", "relations": [{"rel": "heldAt", "entity": "Branch", "filters": ["branch_name"]}]},
    {"op": "create", "entity": "Book", "data": {"title": "x"}, "resolve": {"heldAt": {"entity": "Branch", "filters": ["branch_name"]}}},
    {"op": "query", "entity": "Book", "aggregate": {"fn": [], "field": "pages"}},
    {"op": "query", "entity": "Book", "aggregate": {"fn": "sum", "field": ["pages"]}},
    {"op": "query", "entity": "Book", "sort": {"field": ["pages"]}},
    {"op": "query", "entity": "Book", "sort": {"field": "pages", "dir": []}},
    {"op": "link", "relation": [], "from": {}, "to": {}},
    {"op": "link", "relation": "writtenBy", "from": {"entity": []}, "to": []},
    {"op": "action", "action": []},
    {"op": "action", "action": "x", "params": []},
])
def test_parts_of_the_wrong_kind_are_errors(engine, op):
    r = engine.execute([op])
    assert not r.ok
    assert "not valid" in r.text


def test_a_strange_error_leaves_nothing_staged(engine, monkeypatch):
    def fail(*_):
        raise RuntimeError("the disk is gone")

    monkeypatch.setattr("weftline.engine.check_rows", fail)
    files = engine.source.files
    before = files.names(f"{engine.source.root}/data")
    r = engine.execute([book()])
    assert not r.ok
    assert "the disk is gone" in r.text
    assert files.names(f"{engine.source.root}/data") == before


def test_a_broken_manifest_is_passed_over(engine):
    store = engine.source
    before, version = rows(engine, "lib_books"), store.version()
    store.files.create(f"{store.root}/manifest-{version + 1:010d}.json", '{"version": 9, "tab')
    assert rows(engine, "lib_books") == before
    assert engine.execute([book("after")]).ok
    assert store.version() == version + 2
    assert len(rows(engine, "lib_books")) == len(before) + 1
    assert not [n for n in store.files.names(store.root) if n.startswith(".staged")]


def test_manifest_names_are_taken_once(engine):
    files, root = engine.source.files, engine.source.root
    assert files.create(f"{root}/x.json", "1")
    assert not files.create(f"{root}/x.json", "2")
    assert files.read(f"{root}/x.json") == "1"


def test_vacuum_spares_what_a_transaction_has_staged(engine):
    tx = engine.source.transaction()
    tx.change("lib_books", F.col("title") == "title 1", {"pages": F.lit(77)})
    engine.source.vacuum()
    tx.commit()
    assert engine.source.table("lib_books").where("pages = 77").count() == 1
    orphan = engine.source.transaction()
    orphan.change("lib_books", None, {"pages": F.lit(1)})
    assert engine.source.vacuum(age=-1) > 0
    assert engine.source.table("lib_books").where("pages = 77").count() == 1


def test_jdbc_tables_aggregate_in_the_database(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db2;create=true"
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    orders.write.format("jdbc").option("url", url).option("dbtable", "orders").option("createTableColumnTypes", "o_orderstatus varchar(20), o_orderpriority varchar(20)").save()
    engine = Engine(spark, star_mapping(), JdbcTables(spark, url, "APP", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}, upper=True))
    for ask, pushed, want in (
        ({"aggregate": {"fn": "count"}}, "COUNT(*)", orders.count()),
        ({"aggregate": {"fn": "max", "field": "total"}, "filters": {"status": "F"}}, 'MAX("o_totalprice")', orders.where("o_orderstatus = 'F'").agg(F.max("o_totalprice")).first()[0]),
        ({"aggregate": {"fn": "sum", "field": "order_key"}}, 'SUM("o_orderkey")', orders.agg(F.sum("o_orderkey")).first()[0]),
    ):
        df = engine.frame({"op": "query", "entity": "Order", **ask})
        assert f"PushedAggregates: [{pushed}]".replace('"', "") in plan_of(df).replace('"', "")
        assert df.first()[0] == want
    top = engine.frame({"op": "query", "entity": "Order", "sort": {"field": "order_key", "dir": "desc"}, "limit": 3, "fields": ["order_key"]})
    assert [r[0] for r in top.collect()] == [r[0] for r in orders.orderBy(F.desc("o_orderkey")).limit(3).select("o_orderkey").collect()]


def test_jdbc_catalog(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    nation = spark.read.parquet(f"{SF}/nation.parquet")
    nation.write.format("jdbc").option("url", url).option("dbtable", "nation").save()
    spark.read.parquet(f"{SF}/region.parquet").write.format("jdbc").option("url", url).option("dbtable", "region").save()
    catalog = JdbcCatalog(spark, url, partition={"nation": ("n_nationkey", 0, 25, 3)})
    df = Engine(spark, star_mapping(), catalog).frame({"op": "query", "entity": "Nation", "filters": {"nation_key": 3}, "relations": [{"rel": "inRegion", "entity": "Region"}]})
    assert "PushedFilters: [*EqualTo(n_nationkey,3)" in plan_of(df).replace("*IsNotNull(n_nationkey), ", "").replace("*IsNotNull(n_regionkey), ", "")
    assert [tuple(r) for r in df.collect()] == [tuple(r) for r in nation.where("n_nationkey = 3").collect()]
