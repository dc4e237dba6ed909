"""Fields of XML and JSON records."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

DC = "http://purl.org/dc/elements/1.1/"
DC_FIELDS = ("identifier", "title", "description", "subject", "language", "date", "creator", "type")


def _root(text: str | None) -> ET.Element | None:
    try:
        return ET.fromstring(text) if text else None
    except ET.ParseError:
        return None


def oai_fields(df: DataFrame, xml: str, fields: Sequence[str] = DC_FIELDS) -> DataFrame:
    """``df`` with the first Dublin Core element of each name; null if absent, or the XML is broken."""
    schema = ", ".join(f"`{f}` string" for f in fields)

    @F.pandas_udf(f"struct<{schema.replace(' string', ': string')}>")
    def read(c: pd.Series) -> pd.DataFrame:
        rows = []
        for text in c:
            root = _root(text)
            found = [None if root is None else root.find(f".//{{{DC}}}{f}") for f in fields]
            rows.append([None if e is None else e.text for e in found])
        return pd.DataFrame(rows, columns=list(fields))

    return df.withColumn("_dc", read(F.col(xml))).select(*df.columns, *[F.col(f"_dc.{f}").alias(f"dc_{f}" if f in df.columns else f) for f in fields])


def tag_census(df: DataFrame, key: str, xml: str, most: int = 120) -> DataFrame:
    """``tag, n_documents, example``: distinct tags with the first non-empty text in the order of ``key``."""
    kind = dict(df.dtypes)[key]

    def tags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, text in zip(b[key], b[xml], strict=True):
                root, first = _root(text), {}
                for e in root.iter() if root is not None else ():
                    value = (e.text or "").strip()[:most]
                    if value or e.tag not in first:
                        first.setdefault(e.tag, value) if first.get(e.tag) else first.__setitem__(e.tag, value)
                rows += [(k, t, v) for t, v in first.items()]
            yield pd.DataFrame(rows, columns=[key, "tag", "value"])

    long = df.select(key, xml).mapInPandas(tags, f"`{key}` {kind}, tag string, value string")
    return long.groupBy("tag").agg(
        F.count_distinct(key).alias("n_documents"), F.min_by("value", F.when(F.col("value") != "", F.col(key))).alias("example")
    )


def with_abstract(df: DataFrame, index: str, out: str = "abstract") -> DataFrame:
    """``df`` with the text of an inverted index word -> positions: words by position, the first writer of a position wins.

    Words and positions are sorted once and compared with their neighbour; in
    steps, so that the sorted array is a column and isn't computed again for
    every word.
    """
    entries = F.map_entries(F.col(index))
    placed = F.flatten(F.transform(entries, lambda e, i: F.transform(e["value"], lambda p: F.struct(p.alias("p"), i.alias("i"), e["key"].alias("w")))))
    step = df.withColumn("_placed", F.array_sort(placed))
    kept = F.filter("_placed", lambda x, i: (i == 0) | (F.get("_placed", i - 1)["p"] != x["p"]))
    return step.withColumn(out, F.array_join(F.transform(kept, lambda x: x["w"]), " ")).drop("_placed")


def _leaves(values: list) -> list:
    out: list = []
    for v in values:
        out.extend(_leaves(v) if isinstance(v, list) else [v])
    return out


def value_at(document: object, path: str) -> object:
    """Value of a dotted path in a parsed document; lists on the way are mapped over and the results flattened."""
    here, many = [document], False
    for key in path.split("."):
        opened: list = []
        for v in here:
            many |= isinstance(v, list)
            opened.extend(_leaves(v) if isinstance(v, list) else [v])
        here = [v.get(key) if isinstance(v, dict) else None for v in opened]
    return _leaves(here) if many else here[0]


def _as_text(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def json_path(text: Column, path: str) -> Column:
    """Value of a dotted path as text: lists on the way are mapped over; lists and objects come out as JSON; missing is null.

    A text without a list is read by the JVM; only others are sent, in Arrow
    batches, to a Python worker, as a path that maps over lists at unknown places
    has no built-in form. A text that isn't JSON gives null.
    """

    @F.arrow_udf(StringType())
    def mapped(texts: pa.Array) -> pa.Array:
        if texts.null_count == len(texts):
            return texts.cast(pa.string())
        out = []
        for t in texts.to_pylist():
            try:
                out.append(None if t is None else _as_text(value_at(json.loads(t), path)))
            except ValueError:
                out.append(None)
        return pa.array(out, pa.string())

    listed = F.contains(text, F.lit("["))
    return F.coalesce(mapped(F.when(listed, text)), F.when(~listed, F.get_json_object(text, "$." + path)))
