"""Writers that verify what they wrote before it takes the old one's place."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from colophon.operators.profiling import multiset_difference


def write_single(df: DataFrame, path: str, compression: str = "snappy") -> str:
    """One Parquet file (small results); an empty frame still leaves its schema."""
    df.coalesce(1).write.mode("overwrite").parquet(path, compression=compression)
    return path


class Files:
    """The file system a path lies on (local, HDFS, object store), through Hadoop's interface."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm.org.apache.hadoop.fs
        self.system = self.jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self.system.exists(self.jvm.Path(path))

    def delete(self, path: str) -> None:
        self.system.delete(self.jvm.Path(path), True)

    def rename(self, old: str, new: str) -> None:
        if not self.system.rename(self.jvm.Path(old), self.jvm.Path(new)):
            raise OSError(f"{old} could not be moved to {new}")

    def write_text(self, text: str, path: str) -> None:
        out = self.system.create(self.jvm.Path(path), True)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()


def promote(spark: SparkSession, pairs: list[tuple[str, str]]) -> None:
    """Move staged outputs into place together; on any failure all old ones are put back."""
    if not pairs:
        return
    files = Files(spark, pairs[0][1])
    missing = [s for s, _ in pairs if not files.exists(s)]
    if missing:
        raise FileNotFoundError(f"nothing staged at {missing}")
    moved: list[tuple[str, str | None]] = []
    try:
        for staged, final in pairs:
            backup = f"{final}.previous" if files.exists(final) else None
            if backup:
                files.delete(backup)
                files.rename(final, backup)
            moved.append((final, backup))
            files.rename(staged, final)
    except Exception:
        for final, backup in reversed(moved):
            files.delete(final)
            if backup:
                files.rename(backup, final)
        raise
    for _, backup in moved:
        if backup:
            files.delete(backup)


def write_verified(df: DataFrame, path: str, kind: str = "parquet", **options: str) -> str:
    """Write beside ``path``, read back, compare every cell and the columns, then put it in place."""
    staged = f"{path}.pending"
    df.write.mode("overwrite").format(kind).options(**options).save(staged)
    reader = df.sparkSession.read.schema(df.schema).format(kind).options(**options)
    back = reader.load(staged)
    if back.columns != df.columns or not multiset_difference(df, back).isEmpty():
        raise ValueError(f"what was read back from {staged} differs")
    promote(df.sparkSession, [(staged, path)])
    return path


def write_json(value: object, path: str) -> str:
    """A small JSON document, replaced at once."""
    Path(f"{path}.pending").write_text(json.dumps(value, indent=2, ensure_ascii=False, default=str) + "\n", encoding="utf-8")
    os.replace(f"{path}.pending", path)
    return path
