"""Read-only tables by name: Parquet files of a folder, session tables, or JDBC."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ParquetCatalog:
    """``{folder}/{table}.parquet``, with casts of single columns where the declared type differs from the file's."""

    def __init__(self, spark: SparkSession, folder: str, casts: dict[str, dict[str, str]] | None = None):
        self.spark, self.folder, self.casts = spark, folder.rstrip("/"), casts or {}

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return df.withColumns({c: F.col(c).cast(t) for c, t in self.casts.get(name, {}).items()})


class SessionCatalog:
    """Tables and views of the session, as ``{schema}.{table}`` where a schema is given."""

    def __init__(self, spark: SparkSession, schema: str = ""):
        self.spark, self.schema = spark, schema

    def table(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.schema}.{name}" if self.schema else name)


class JdbcCatalog:
    """Tables of a database; filters and columns are pushed into its scans.

    ``partition`` maps a table to (column, lower, upper, partitions) to read it in parallel.
    """

    def __init__(self, spark: SparkSession, url: str, options: dict | None = None, partition: dict | None = None):
        self.spark, self.url, self.options, self.partition = spark, url, options or {}, partition or {}

    def table(self, name: str) -> DataFrame:
        reader = self.spark.read.format("jdbc").option("url", self.url).option("dbtable", name).options(**self.options)
        if name in self.partition:
            column, lower, upper, n = self.partition[name]
            reader = reader.option("partitionColumn", column).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", n)
        return reader.load()


class JdbcTables:
    """Tables of a database schema as a catalog of the session, so that aggregates, limits and sorts with a limit run there too.

    A table is read by one connection: this is for questions that the database answers shortly; ``JdbcCatalog`` reads in parallel.
    ``limits`` is for databases whose dialect in Spark writes limits; Derby's doesn't, and would give all rows.
    """

    def __init__(self, spark: SparkSession, url: str, schema: str, options: dict | None = None, upper: bool = False, limits: bool | None = None):
        self.spark, self.schema, self.upper = spark, schema, upper
        self.name = f"weftline_{uuid.uuid4().hex}"
        limits = not url.startswith("jdbc:derby:") if limits is None else limits
        pushed = {f"pushDown{what}": str(on).lower() for what, on in (("Aggregate", True), ("Limit", limits), ("Offset", limits), ("TableSample", False))}
        spark.conf.set(f"spark.sql.catalog.{self.name}", "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog")
        for key, value in {"url": url, **pushed, **(options or {})}.items():
            spark.conf.set(f"spark.sql.catalog.{self.name}.{key}", value)

    def table(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.name}.`{self.schema}`.`{name.upper() if self.upper else name}`")
