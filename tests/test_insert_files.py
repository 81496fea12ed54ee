"""INSERT text cut by tasks, against the reader of whole texts."""

import datetime as dt

import pytest

from weftline.design import schema, seed
from weftline.errors import ConstraintViolation, StoreError
from weftline.sources import insert_files, inserts
from weftline.sources.store import Store
from weftline.star import library

TEXT = """-- seeds; with a 'quote and ( a parenthesis
CREATE TABLE x (a int, b text);
INSERT INTO t (a, b) VALUES (1, 'it''s; (fine)'), (2, NULL);
insert into "t" (b,
  a) values
  ('over
two lines; -- no comment', 3) -- a comment, 'quoted
  , ('', 4),
  ('''', -5.5);
INSERT INTO u (d) VALUES (date '2020-01-02'), ('2020-01-03'::date); INSERT INTO t (a, b) VALUES (6, '('), (7, ')'), (8, 'insert into t values (9);');
COMMENT ON x
IS 'values (1)';
INSERT INTO t (a, b) VALUES
(true, 'VALUES'),
(10, 'x')
"""


def plain(text):
    out = []
    for i in inserts.read(text):
        out += [(i.table, i.columns, tuple(v if v is None else str(v).lower() if isinstance(v, bool) else v for v in r)) for r in i.rows]
    return out


@pytest.mark.parametrize("size", [7, 20, 33, 64, 100, 10_000])
def test_splits_anywhere_give_the_same_rows(spark, tmp_path, size):
    for name in "ab":
        (tmp_path / "text").mkdir(exist_ok=True)
        (tmp_path / "text" / f"{name}.sql").write_text(TEXT)
    made = iter(range(100))

    def save(df, name):
        at = f"{tmp_path}/{name}-{next(made)}"
        df.write.parquet(at)
        return spark.read.parquet(at)

    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        rows, n = insert_files.read(spark, str(tmp_path / "text"), save)
        got = [(r["name"], tuple(r["columns"]), tuple(r["literals"])) for r in rows.orderBy("path", "start", "at", "n").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == plain(TEXT) * 2
    assert n == 2 * len(inserts.read(TEXT))


def test_files_load_as_text_does(spark, tmp_path):
    _, _, s, _ = library()
    good = "INSERT INTO lib_genre_values (code, label) VALUES ('novel', 'Novel');\nINSERT INTO lib_branchs (branch_name) VALUES ('a'), ('b');\nINSERT INTO lib_books (title, pages, genre, lib_branch_id) VALUES ('t', 3, 'novel', 2),\n('it''s', 4, 'novel', 1);\nINSERT INTO lib_books (lib_book_id, title, pages, genre, lib_branch_id) VALUES (77, 'u', 3, 'novel', 2);\n"
    whole, files = Store(spark, str(tmp_path / "a")), Store(spark, str(tmp_path / "b"))
    (tmp_path / "good.sql").write_text(good)
    for store in (whole, files):
        store.create(schema.store_tables(s))
    assert seed.load_inserts(whole, good) == seed.load_insert_files(files, str(tmp_path / "good.sql")) == 4
    for t in ("lib_genre_values", "lib_branchs", "lib_books"):
        assert sorted(map(repr, whole.table(t).collect())) == sorted(map(repr, files.table(t).collect()))
    assert files.table("lib_books").first()["created_at"] == dt.datetime(2024, 1, 1)
    assert files.manifest()["tables"]["lib_books"]["next_key"] == 78
    assert not [f for f in files.files.names(f"{files.root}/data") if f.startswith("text-")]
    before = files.version()
    for text, error, says in (("INSERT INTO lib_books (title, pages, genre, lib_branch_id) VALUES ('t', 3, 'novel', 9);", ConstraintViolation, "no lib_branch_id 9"), ("INSERT INTO lib_branchs (branch_name, city) VALUES ('a', 'b');", StoreError, "no column city"), ("INSERT INTO lib_branchs (branch_name) VALUES ('a', 'b');", StoreError, "as many values"), ("INSERT INTO lib_branchs (branch_name) VALUES (now());", StoreError, "not a row"), ("INSERT INTO lib_books (pages) VALUES ('many');", StoreError, "lib_books"), ("INSERT INTO films (a) VALUES (1);", StoreError, "no table films")):
        (tmp_path / "bad.sql").write_text(text)
        with pytest.raises(error, match=says):
            seed.load_insert_files(files, str(tmp_path / "bad.sql"))
        assert files.version() == before
    (tmp_path / "none.sql").write_text("-- nothing\n")
    assert seed.load_insert_files(files, str(tmp_path / "none.sql")) == 0
