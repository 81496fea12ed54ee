"""Runs of like operations against the same operations one by one."""

import uuid

import pytest
from pyspark.sql import functions as F

from weftline import runs, stores
from weftline.design import schema, seed
from weftline.engine import Engine
from weftline.model import mapping as maps
from weftline.sources.store import Store
from weftline.star import library

SF = "/root/testdata/sf0.001"


def fresh(spark, root, rows=12):
    _, _, s, m = library()
    store = Store(spark, root)
    store.create(schema.store_tables(s))
    seed.fill(store, s, rows=rows, pairs=4)
    return Engine(spark, m, store, owned=maps.ownership(m, "Branch"))


def link(op, book, author):
    return {"op": op, "relation": "writtenBy", "from": {"entity": "Book", "filters": {"title": f"title {book}"}}, "to": {"entity": "Author", "filters": {"full_name": f"full name {author}"}}}


def book(i, branch=2, **data):
    return {"op": "create", "entity": "Book", "data": {"title": f"new {i}", "pages": i, "genre": "novel"} | data, "resolve": {"heldAt": {"entity": "Branch", "filters": {"branch_name": f"branch name {branch}"}}}}


def state(engine):
    return {t: sorted(map(repr, engine.source.table(t).drop("created_at").collect())) for t in engine.source.manifest()["tables"]}


def without_time(text):
    return "\n".join(line for line in text.split("\n") if "created_at" not in line)


LINKS = [link("link", b, a) for b, a in ((5, 5), (5, 6), (5, 5), (1, 1), (7, 8), (9, 9), (9, 9), (10, 1))]
BATCHES = {
    "links": LINKS,
    "unlinks": [*LINKS, *(link("unlink", b, a) for b, a in ((5, 5), (5, 5), (1, 2), (11, 11), (7, 8), (9, 9), (3, 3), (10, 1)))],
    "creates": [book(i, 1 + i % 5) for i in range(9)],
    "a key that isn't found": [book(i, i * 100) for i in range(9)],
    "a link that doesn't fit": [*LINKS[:6], link("link", 99, 1), LINKS[7], LINKS[0]],
    "a value that doesn't fit": [*(book(i) for i in range(8)), book(8, pages="many"), book(9)],
    "a value that isn't allowed": [book(0), *(book(i, genre="poetry" if i != 6 else "drama") for i in range(1, 9))],
    "several runs": [*LINKS, {"op": "query", "entity": "Book", "aggregate": {"fn": "count"}}, *(book(i) for i in range(8)), {"op": "query", "entity": "Book", "aggregate": {"fn": "count"}}, *(link("unlink", 5, a) for a in range(1, 9))],
}


@pytest.mark.parametrize("name", sorted(BATCHES))
def test_a_run_says_and_does_what_its_operations_would(spark, tmp_path, monkeypatch, name):
    batch = BATCHES[name]
    together, single = fresh(spark, str(tmp_path / "a")), fresh(spark, str(tmp_path / "b"))
    one = together.execute(batch)
    monkeypatch.setattr(runs, "LEAST", 10**9)
    other = single.execute(batch)
    assert without_time(one.text) == without_time(other.text)
    assert one.ok == other.ok
    assert [e["op"] for e in one.log] == [e["op"] for e in other.log]
    plain = lambda r: {k: v for k, v in r.items() if k != "created_at"} if isinstance(r, dict) else r
    rows = lambda e: [plain(x) for x in e["result"]["returned_data"]] if isinstance(e["result"], dict) else e["result"]
    assert [rows(e) for e in one.log] == [rows(e) for e in other.log]
    assert state(together) == state(single)
    for e in one.log if one.ok else ():
        if e.get("frame") is not None and isinstance(e["result"], dict):
            assert [plain(r.asDict()) for r in e["frame"].collect()] == rows(e)


def jobs(spark, what):
    tracker, group = spark.sparkContext.statusTracker(), f"jobs-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, "")
    what()
    found = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("", "")
    return found


def test_jobs_dont_grow_with_the_run(spark, tmp_path):
    engine = fresh(spark, str(tmp_path / "s"), rows=300)
    pairs = [(i % 300 + 1, i // 300 + 1) for i in range(3000)]
    few = jobs(spark, lambda: engine.execute([link("link", b, a + 200) for b, a in pairs[:10]]))
    many = jobs(spark, lambda: engine.execute([link("link", b, a) for b, a in pairs]))
    assert engine.source.table("lib_book_authors").select("lib_book_id", "lib_author_id").distinct().count() >= 3000
    assert many <= few + 2
    few = jobs(spark, lambda: engine.execute([book(i) for i in range(10)]))
    many = jobs(spark, lambda: engine.execute([book(i) for i in range(2000)]))
    assert many <= few + 2
    assert engine.source.table("lib_books").count() == 300 + 2010
    assert engine.source.table("lib_books").agg(F.countDistinct("lib_book_id")).first()[0] == 2310


def test_a_scoped_run_keeps_to_its_scope(spark, tmp_path):
    engine = fresh(spark, str(tmp_path / "s"))
    books = {r["title"]: r["lib_branch_id"] for r in engine.source.table("lib_books").collect()}
    own = next(b for b in books.values())
    mine = [t.split()[1] for t, b in books.items() if b == own]
    other = next(t.split()[1] for t, b in books.items() if b != own)
    batch = [link("link", b, a) for b in mine[:1] for a in range(1, 10)]
    assert engine.execute(batch, identity=own).ok
    r = engine.execute([*batch[:8], link("link", other, 1)], identity=own)
    assert "Operation 9 FAILED" in r.text
    assert "no match" in r.text
    made = engine.execute([book(i) for i in range(8)], identity=own)
    assert {e["result"]["returned_data"][0]["lib_branch_id"] for e in made.log} == {own}


def test_rows_of_a_run_that_may_refer_to_each_other_are_no_run(spark):
    store = stores.ranged_store(spark, SF, "nation")
    engine = stores.ranged_engine(spark, store)
    batch = [{"op": "create", "entity": "Nation", "data": {"nation_key": 100 + i, "name": f"n{i}"}} for i in range(9)]
    assert engine.execute(batch).ok
    r = engine.execute([*batch[:0], *({"op": "create", "entity": "Nation", "data": {"nation_key": 200 + i % 8, "name": "x"}} for i in range(9))])
    assert "Operation 9 FAILED" in r.text
    assert "must be unique" in r.text
    assert store.table("nation").where("n_nationkey >= 200").count() == 0
