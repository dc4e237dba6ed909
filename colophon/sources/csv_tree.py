"""Trees of CSV files with differing headers, read into one table."""

from __future__ import annotations

import codecs
import csv
import io
import os
import re
from collections.abc import Iterator, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROVENANCE = {"source_filename": "_metadata.file_name", "source_mtime": "_metadata.file_modification_time"}


def find_files(folder: str) -> list[str]:
    """CSV files below a folder, any case of the ending, sorted by path."""
    return sorted(str(p) for p in Path(folder).rglob("*") if p.is_file() and p.suffix.lower() == ".csv")


def guard_output(folder: str, *outputs: str) -> None:
    """Outputs inside the input tree would be read as inputs."""
    base = Path(folder).resolve()
    for out in outputs:
        if base == Path(out).resolve() or base in Path(out).resolve().parents:
            raise ValueError(f"{out} must be outside the input directory {folder}")


def _rows(data: bytes, backslash: bool) -> Iterator[list[str]]:
    text = data.decode("utf-8-sig", errors="replace")
    csv.field_size_limit(2**31 - 1)
    yield from csv.reader(io.StringIO(text, newline=""), escapechar="\\" if backslash else None, doublequote=True)


def _stream(path: str, backslash: bool) -> Iterator[list[str]]:
    """Records of a file, read as they are asked for."""
    csv.field_size_limit(2**31 - 1)
    with open(path, encoding="utf-8-sig", errors="replace", newline="") as f:
        yield from csv.reader(f, escapechar="\\" if backslash else None, doublequote=True)


def headers(folder: str, backslash: bool = True) -> tuple[list[str], bool, list[str], dict[str, list[str]]]:
    """(sorted union of columns, all alike, files that differ from the first, columns by file). Reads first records only."""
    by: dict[str, list[str]] = {}
    for path in find_files(folder):
        row = next(_stream(path, backslash), [])
        by[path] = [c.strip() for c in row if c.strip()]
    first = next(iter(by.values()), [])
    differ = [p for p, c in by.items() if c != first or not c]
    return sorted({c for cols in by.values() for c in cols}), not differ, differ, by


def read_union(spark: SparkSession, folder: str, backslash_compat: bool = True, columns: Sequence[str] | None = None) -> DataFrame:
    """All files as one table of strings: the sorted union of columns; what a file lacks, and empty cells, are null.

    With ``backslash_compat`` a backslash escapes the next character and is
    itself dropped, short rows are filled up and surplus cells dropped; each file
    is then one task (a quoted line break can't be told from the middle of a
    file). Without it Spark's own reader splits large files.
    """
    names, _, _, by = headers(folder, backslash_compat)
    names = list(columns or names)
    schema = ", ".join(f"`{c}` string" for c in names)
    if not by or not names:
        return spark.createDataFrame([], schema or "empty string")
    if not backslash_compat:
        out = None
        for cols in sorted({tuple(c) for c in by.values() if c}):
            paths = [p for p, c in by.items() if tuple(c) == cols]
            part = spark.read.csv(paths, schema=", ".join(f"`{c}` string" for c in cols), header=True, multiLine=True, quote='"', escape='"', nullValue="")
            part = part.select(*[(F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`")) if c in cols else F.lit(None).cast("string")).alias(c) for c in names])
            out = part if out is None else out.unionByName(part)
        return out

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["content"]:
                rows = _rows(data, True)
                header = [c.strip() for c in next(rows, [])]
                at = {c: i for i, c in enumerate(header) if c}
                block: list[list[str | None]] = []
                for r in rows:
                    if r:
                        block.append([(r[at[c]] or None) if c in at and at[c] < len(r) else None for c in names])
                    if len(block) >= 50_000:
                        yield pd.DataFrame(block, columns=names, dtype=object)
                        block = []
                yield pd.DataFrame(block, columns=names, dtype=object)

    files = spark.read.format("binaryFile").load(list(by))
    return files.repartition(max(1, min(len(by), 10_000)), "path").select("content").mapInPandas(parse, schema)


def encoding_of(path: str, block: int = 1 << 20) -> str:
    """The first of UTF-8 and Latin-1 that decodes the whole file; read in blocks."""
    decoder = codecs.getincrementaldecoder("utf-8")()
    with open(path, "rb") as f:
        try:
            while data := f.read(block):
                decoder.decode(data)
            decoder.decode(b"", final=True)
        except UnicodeDecodeError:
            return "latin-1"
    return "utf-8-sig"


def sniff(path: str, size: int = 2048) -> tuple[str, str]:
    """(delimiter by the first characters, encoding by the whole) of a file."""
    encoding = encoding_of(path)
    with open(path, encoding=encoding, newline="") as f:
        text = f.read(size)
    counts = {d: min((line.count(d) for line in text.splitlines()[:5] if line), default=0) for d in (";", ",", "\t")}
    best = max(counts, key=lambda d: counts[d])
    return (best if counts[best] else ","), ("UTF-8" if encoding.startswith("utf") else "ISO-8859-1")


def read_sniffed(spark: SparkSession, path: str) -> DataFrame:
    """A file in its own dialect, columns as text, broken lines skipped, with name, time and year of the file."""
    sep, encoding = sniff(path)
    df = spark.read.csv(path, header=True, sep=sep, encoding=encoding, mode="DROPMALFORMED", quote='"', escape='"')
    year = re.findall(r"(?:19|20)\d{2}", os.path.basename(path))
    return df.select(*df.columns, *[F.col(v).alias(k) for k, v in PROVENANCE.items()], F.lit(int(year[-1]) if year else None).cast("int").alias("year"))


def read_fixed(spark: SparkSession, path: str, schema: str, sep: str = ";") -> DataFrame:
    """Given names and types; further cells are dropped, missing ones null."""
    return spark.read.csv(path, schema=schema, header=True, sep=sep, mode="PERMISSIVE")


def parity(spark: SparkSession, folder: str, *stages: tuple[str, DataFrame]) -> DataFrame:
    """``stage, n_rows``: rows of every file, of all files, and of the later stages."""
    rows = [(os.path.relpath(p, folder), sum(1 for r in _stream(p, True) if r) - 1) for p in find_files(folder)]
    rows = [(n, max(0, k)) for n, k in rows]
    rows.append(("all files", sum(k for _, k in rows)))
    out = spark.createDataFrame(rows, "stage string, n_rows bigint")
    for name, df in stages:
        out = out.unionByName(df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("stage"), "n_rows"))
    return out
