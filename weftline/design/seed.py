"""Seed rows: lookup codes, junction pairs, entities by a fixed rule; and loading of INSERT text."""

from __future__ import annotations

import re

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import StoreError, WeftlineError
from ..functions.literals import coerce
from ..sources import insert_files, inserts
from ..sources.constraints import check_rows
from ..sources.store import Store, Transaction
from .schema import struct_of

ROWS, PAIRS = 10, 5
#: Heads of a table's INSERT statements up to which each has its own way to a column's literal.
FORMS = 8


def lookup_rows(spark: SparkSession, table: dict) -> DataFrame:
    """code, label, sort_order, active: one row for each code in order."""
    rows = [(code, code.replace("_", " ").title(), i, True) for i, code in enumerate(table["codes"], 1)]
    return spark.createDataFrame(rows, "code string, label string, sort_order int, active boolean")


def junction_rows(spark: SparkSession, table: dict, rows: int = ROWS, pairs: int = PAIRS) -> DataFrame:
    """(1, 1), (1, 2), ... in order, ``pairs`` at most."""
    a, b = (k["column"] for k in table["foreign_keys"])
    n = min(pairs, rows * rows)
    i = spark.range(n)
    return i.select((F.col("id") + 1).cast("int").alias(table["primary_key"]), (F.floor(F.col("id") / rows) + 1).cast("int").alias(a), (F.col("id") % rows + 1).cast("int").alias(b))


def entity_rows(spark: SparkSession, table: dict, schema: dict, rows: int = ROWS) -> DataFrame:
    """Rows 1 to ``rows`` whose values follow from the row's number and the column's name."""
    columns = {c["name"]: c for c in table["columns"]}
    keys = {k["column"] for k in table["foreign_keys"]}
    n = F.col("id") + 1
    out = []
    for f in struct_of(table, schema).fields:
        h = F.pmod(F.xxhash64(F.lit(f.name), n), F.lit(10_000))
        spec = columns.get(f.name, {})
        if f.name == table["primary_key"]:
            v = n
        elif f.name in keys:
            v = F.pmod(h, F.lit(rows)) + 1
        elif spec.get("allowed_values"):
            v = F.element_at(F.array(*map(F.lit, spec["allowed_values"])), (F.pmod(h, F.lit(len(spec["allowed_values"]))) + 1).cast("int"))
        elif f.name == "created_at":
            v = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))
        elif isinstance(f.dataType, T.StringType):
            v = F.concat(F.lit(f.name.replace("_", " ") + " "), n.cast("string"))
        elif isinstance(f.dataType, T.BooleanType):
            v = F.pmod(h, F.lit(2)) == 1
        elif isinstance(f.dataType, T.DateType):
            v = F.date_add(F.lit("2020-01-01").cast("date"), F.pmod(h, F.lit(1500)).cast("int"))
        elif isinstance(f.dataType, T.TimestampNTZType):
            v = F.date_add(F.lit("2020-01-01").cast("date"), F.pmod(h, F.lit(1500)).cast("int")).cast("timestamp_ntz")
        elif isinstance(f.dataType, T.DecimalType):
            v = h / 100
        else:
            v = h
        out.append(v.cast(f.dataType).alias(f.name))
    return spark.range(rows).select(*out)


def fill(store: Store, schema: dict, rows: int = ROWS, pairs: int = PAIRS) -> dict[str, int]:
    """Seed all tables in creation order as one commit; rows by table."""
    by_name, counts = {t["name"]: t for t in schema["tables"]}, {}
    with store.transaction() as tx:
        for n in schema["creation_order"]:
            t = by_name[n]
            if t.get("lookup_table"):
                df = lookup_rows(store.spark, t)
            elif len(t["foreign_keys"]) >= 2 and not t["columns"]:
                df = junction_rows(store.spark, t, rows, pairs)
            else:
                df = entity_rows(store.spark, t, schema, rows)
            have = set(df.columns)
            df = df.select(*[F.col(f.name) if f.name in have else F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")).alias(f.name) for f in tx.schema(n).fields])
            new = tx.append(n, df)
            check_rows(tx, n, new)
            counts[n] = new.count()
    return counts


def _stage(tx: Transaction, text: str) -> int:
    done = 0
    for insert in inserts.read(text):
        schema, entry = tx.schema(insert.table), tx.entry(insert.table)
        unknown = [c for c in insert.columns if c not in schema.names]
        if unknown:
            raise StoreError(f"{insert.table} has no column {', '.join(unknown)}")
        defaults, rows = entry["constraints"].get("defaults", {}), []
        for values in insert.rows:
            row = dict(zip(insert.columns, values, strict=True))
            key = entry["primary_key"]
            if row.get(key) is None and key in schema.names and not isinstance(schema[key].dataType, T.StringType):
                row[key] = tx.take_key(insert.table)
            if "created_at" in schema.names:
                row.setdefault("created_at", "2024-01-01T00:00:00")
            rows.append(tuple(coerce(row.get(f.name, defaults.get(f.name)), f.dataType, f.name) for f in schema.fields))
        check_rows(tx, insert.table, tx.append(insert.table, tx.spark.createDataFrame(rows, schema)))
        done += 1
    return done


def load_inserts(store: Store, text: str) -> int:
    """Run INSERT statements as one commit; how many there were."""
    with store.transaction() as tx:
        return _stage(tx, text)


def check_inserts(store: Store, text: str) -> list[str]:
    """What loading the text would fail with; nothing is kept."""
    tx = store.transaction()
    try:
        _stage(tx, text)
        return []
    except WeftlineError as e:
        return [str(e)]
    finally:
        tx.rollback()


def _typed(tx: Transaction, name: str, rows: DataFrame, heads: list[str]) -> DataFrame:
    """Rows of literals under these heads as rows of a table, with defaults and next keys as ``_stage`` gives them."""
    schema, entry = tx.schema(name), tx.entry(name)
    unknown = sorted({c for h in heads for c in h.split(",")[1:]} - set(schema.names))
    if unknown:
        raise StoreError(f"{name} has no column {', '.join(unknown)}")
    defaults = {"created_at": "2024-01-01T00:00:00"} | entry["constraints"].get("defaults", {})
    given = F.map_from_arrays("columns", "literals")

    def value(c: str) -> Column:
        default = F.lit(defaults.get(c)).cast("string")
        if len(heads) > FORMS:
            return F.when(F.array_contains("columns", c), F.element_at(given, F.lit(c))).otherwise(default)
        forms = [F.col("literals")[h.split(",")[1:].index(c)] if c in h.split(",")[1:] else default for h in heads]
        out = forms[-1]
        for h, form in zip(heads[:-1], forms[:-1], strict=True):
            out = F.when(F.col("head") == h, form).otherwise(out)
        return out

    rows = rows.select("path", "start", "at", "n", *[value(f.name).alias(f.name) for f in schema.fields])
    key = entry["primary_key"]
    if key in schema.names and not isinstance(schema[key].dataType, T.StringType):
        # numbers in order, by split and then over splits, of which there is a row each
        lacks = F.col(key).isNull()
        number = F.sum(lacks.cast("long")).over(Window.partitionBy("path", "start").orderBy("at", "n"))
        splits = rows.groupBy("path", "start").agg(F.sum(lacks.cast("long")).alias("_lack"))
        before = F.coalesce(F.sum("_lack").over(Window.orderBy("path", "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        splits = splits.select("path", "start", before.alias("_before"))
        rows = rows.withColumn("_number", number).join(splits, ["path", "start"])
        rows = rows.withColumn(key, F.coalesce(key, (F.lit(entry["next_key"] - 1) + F.col("_before") + F.col("_number")).cast("string")))
    return rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])


def load_insert_files(store: Store, path: str) -> int:
    """Run the INSERT statements of text files as one commit, read by Spark's tasks whatever their size; how many there were.

    A table's rows are checked together, tables in the order of their first rows.
    """
    with store.transaction() as tx:
        scratch = []

        def save(df: DataFrame, name: str) -> DataFrame:
            scratch.append(tx.folder(f"text-{name}"))
            df.write.parquet(scratch[-1])
            return store.spark.read.schema(df.schema).parquet(scratch[-1])

        try:
            rows, statements = insert_files.read(store.spark, path, save)
        except PySparkException as e:  # a task's error comes as text
            said = re.search(r"StoreError: (.*)", str(e))
            raise StoreError(said[1] if said else str(e).split("\n", 1)[0]) from e
        place = F.shiftleft("at", 32) + F.col("n")
        heads = rows.groupBy("head", "path", "start").agg(F.min(place).alias("place"), F.min("size").alias("least"), F.max("size").alias("most"))
        heads = heads.groupBy("head").agg(F.min(F.struct("path", "start", "place")).alias("first"), F.min("least").alias("least"), F.max("most").alias("most"))
        forms: dict[str, list[str]] = {}
        for r in heads.orderBy("first").collect():
            name = r["head"].split(",", 1)[0]
            if {r["least"], r["most"]} != {r["head"].count(",")}:
                raise StoreError(f"a row of {name} has not as many values as columns")
            forms.setdefault(name, []).append(r["head"])
        for name, of in forms.items():
            typed = _typed(tx, name, rows.where(F.col("head").isin(of) if len(of) <= FORMS else F.col("name") == name), of)
            try:
                new = tx.append(name, typed)
            except PySparkException as e:  # a literal that is none of its column's type
                raise StoreError(f"{name}: {str(e).split(chr(10), 1)[0]}") from e
            check_rows(tx, name, new)
        for folder in scratch:
            tx.discard(folder)
        return statements
