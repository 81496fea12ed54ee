"""What a manifest knows of files without opening them.

For each file its number of rows, and for each column (strings only where a constraint names them) its smallest and largest value
and its nulls, strings by their first PREFIX characters.  Files of BLOOM_ROWS rows and more also get a Bloom filter for each key
column, kept in a Parquet file beside them, since its size follows their rows.

All is gathered by Spark from the files as they were written: one aggregate by file, and one by file and word of the filter.
"""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX = 32
BLOOM_ROWS = 10_000
#: Bits of a filter for each row of the fullest file, before rounding up to a power of two, and at most.
BLOOM_BITS, MOST_BITS = 10, 1 << 26
PROBES = 4

_PLAIN = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)
BLOOM = "file string, column string, size long, words map<long,bigint>"


def keys_of(entry: dict) -> list[str]:
    """Key columns of a table, by its constraints."""
    rules = entry["constraints"]
    return sorted({*rules.get("unique", ()), *(f[0] for f in rules.get("foreign", ())), *([entry["primary_key"]] if entry["primary_key"] else [])})


def columns_of(entry: dict, schema: T.StructType) -> list[T.StructField]:
    """Columns that facts are kept of."""
    rules = entry["constraints"]
    named = {*keys_of(entry), *rules.get("lengths", ()), *rules.get("allowed", ()), *rules.get("not_null", ())}
    return [f for f in schema.fields if isinstance(f.dataType, _PLAIN) or isinstance(f.dataType, T.StringType) and f.name in named]


def _pack(value):
    """As JSON has it."""
    if isinstance(value, (dt.date, dt.datetime)):
        return value.isoformat()
    return str(value) if isinstance(value, Decimal) else value


def unpack(value, kind: T.DataType):
    if value is None:
        return None
    if isinstance(kind, T.DecimalType):
        return Decimal(value)
    if isinstance(kind, T.DateType):
        return dt.date.fromisoformat(value)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return dt.datetime.fromisoformat(value)
    return value


def gather(df: DataFrame, fields: list[T.StructField]) -> dict[str, dict]:
    """Facts by file name; files without rows have none."""
    wanted = []
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        short = F.substring(c, 1, PREFIX) if isinstance(f.dataType, T.StringType) else c
        wanted += [F.min(short).alias(f"l{i}"), F.max(short).alias(f"h{i}"), F.count(c).alias(f"n{i}")]
        if isinstance(f.dataType, T.StringType):
            wanted.append(F.max(F.length(c)).alias(f"s{i}"))
    out = {}
    for r in df.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("rows"), *wanted).collect():
        known = {}
        for i, f in enumerate(fields):
            low, high = r[f"l{i}"], r[f"h{i}"]
            if isinstance(high, float) and not (math.isfinite(low) and math.isfinite(high)):
                continue
            whole = not isinstance(f.dataType, T.StringType) or (r[f"s{i}"] or 0) <= PREFIX
            known[f.name] = [_pack(low), _pack(high), r["rows"] - r[f"n{i}"], whole]
        out[r["file"]] = {"rows": r["rows"], "columns": known}
    return out


def reach(facts: list[dict], column: str, kind: T.DataType) -> tuple | None:
    """(smallest, largest) of a column over files, None where it has no values; (None, None) where that isn't known."""
    low = high = None
    for fact in facts:
        if column not in fact["columns"]:
            return None, None
        a, b = (unpack(x, kind) for x in fact["columns"][column][:2])
        if a is not None:
            low, high = (a, b) if low is None else (min(low, a), max(high, b))
    return None if low is None else (low, high)


def may_hold(fact: dict | None, ranges: dict[str, tuple], schema: T.StructType) -> bool:
    """Whether a file may have a row whose columns lie in the ranges (smallest, largest); an unknown end is None."""
    for column, (low, high) in ranges.items():
        if fact is None or column not in fact["columns"] or low is None:
            continue
        kind = schema[column].dataType
        a, b = (unpack(x, kind) for x in fact["columns"][column][:2])
        if a is None:  # nulls only, and null equals nothing
            return False
        if isinstance(kind, T.StringType):
            low, high = low[:PREFIX], high[:PREFIX]
        if high < a or b < low:
            return False
    return True


def _places(key: Column, size: Column) -> list[Column]:
    """Bits of a key in a filter of ``size`` bits, a power of two."""
    h = F.xxhash64(key)
    low, step = h.bitwiseAND(F.lit(0x7FFFFFFF)), F.shiftrightunsigned(h, 33).bitwiseOR(F.lit(1))
    return [(low + F.lit(i) * step).bitwiseAND(size - F.lit(1)) for i in range(PROBES)]


def blooms(df: DataFrame, columns: list[str], most_rows: int) -> DataFrame:
    """A filter for each file and key column, as the words that aren't zero."""
    bits = F.lit(min(MOST_BITS, 1 << max(10, (most_rows * BLOOM_BITS - 1).bit_length()))).cast("long")
    file = F.col("_metadata.file_name").alias("file")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.when(F.col(f"`{c}`").isNotNull(), F.array(*_places(F.col(f"`{c}`"), bits))).alias("places")) for c in columns])).alias("e")
    places = df.select(file, each).select("file", "e.column", F.explode("e.places").alias("place"))
    bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
    words = places.groupBy("file", "column", F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy("file", "column").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words")).select("file", "column", bits.alias("size"), "words")


def unlikely(spark: SparkSession, paths: list[str], column: str, value: Column) -> set[str]:
    """Files whose filters rule a value of a key column out."""
    table = spark.read.schema(BLOOM).parquet(*paths).where(F.col("column") == column)
    absent = F.lit(False)
    for place in _places(value, F.col("size")):
        word = F.coalesce(F.element_at("words", F.shiftright(place, 6)), F.lit(0).cast("long"))
        absent = absent | (F.getbit(word, place.bitwiseAND(F.lit(63)).cast("int")) == 0)
    return {r["file"] for r in table.where(absent).select("file").collect()}
