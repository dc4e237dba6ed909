"""Relational sources through JDBC, read in parallel by ranges of the key."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, url: str, query: str, key: str, low: int, high: int, parts: int, fetch: int = 100_000, **options: str) -> DataFrame:
    """A query in ``parts`` ranges of ``key``; rows are streamed in blocks of ``fetch``."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=f"({query}) q", partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts), fetchsize=str(fetch), **options)
        .load()
    )


def catalog(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``table_name, column_name, data_type, example_row``: one row per column, with the table's first row as JSON (null if it is empty).

    One lazy job for all tables; each reads a single row. Of a database: ``session_tables``.
    """
    out = None
    for name, df in tables.items():
        columns = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("data_type")) for c, t in df.dtypes])
        first = df.limit(1).select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("example_row")).agg(F.first("example_row").alias("example_row"))
        rows = first.select(F.lit(name).alias("table_name"), F.explode(columns).alias("c"), "example_row").select("table_name", "c.*", "example_row")
        out = rows if out is None else out.unionByName(rows)
    return out


def session_tables(spark: SparkSession, database: str | None = None) -> dict[str, DataFrame]:
    """Tables and views of the session, by name."""
    return {t.name: spark.table(t.name) for t in spark.catalog.listTables(database)}
