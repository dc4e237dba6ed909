"""From a tree of CSV files to one verified Parquet table with its statistics and audit."""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.operators.profiling import token_parity
from colophon.sources import artifacts, csv_tree, sinks


def data_root(given: str | None = None, variable: str = "COLOPHON_DATA") -> str:
    """The data folder: the argument, else the environment, else an error."""
    path = given or os.environ.get(variable)
    if not path:
        raise ValueError(f"no data folder: pass one or set {variable}")
    return os.path.abspath(os.path.expanduser(path))


def merge_tree(spark: SparkSession, folder: str, out: str, backslash_compat: bool = True) -> dict:
    """Writes ``out`` (Parquet), ``out.stats.json`` and ``out.artifact.json``; gives the statistics."""
    csv_tree.guard_output(folder, out)
    began = time.time()
    columns, same, differ, by = csv_tree.headers(folder, backslash_compat)
    df = csv_tree.read_union(spark, folder, backslash_compat)
    sinks.write_verified(df, out)
    stats = {
        "total_files": len(by), "total_rows": spark.read.parquet(out).count(), "unique_columns": columns,
        "per_file_columns_same": same, "differing_files": differ, "processing_seconds": round(time.time() - began, 3),
    }
    sinks.write_json(stats, f"{out}.stats.json")
    sources = [artifacts.Artifact.of(p).id for p in csv_tree.find_files(folder)]
    sinks.write_json(artifacts.Artifact.of(out, source=sources).record(), f"{out}.artifact.json")
    return stats


def audit(spark: SparkSession, folder: str, out: str) -> tuple[DataFrame, DataFrame]:
    """(rows per file and stage, null tokens per column and stage)."""
    raw, merged = csv_tree.read_union(spark, folder), spark.read.parquet(out)
    return csv_tree.parity(spark, folder, ("parquet", merged)), token_parity({"raw": raw, "parquet": merged}, raw.columns)


def by_year_json(df: DataFrame, year: str, out: str) -> None:
    """One folder of JSON lines per year."""
    df.withColumn("_y", F.col(year)).repartition("_y").write.mode("overwrite").partitionBy("_y").json(out)
