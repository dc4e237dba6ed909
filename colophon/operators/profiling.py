"""Profiles, parity audits and summaries with fixed categories."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that stand for "no value" in exports.
NULL_TOKENS = ("", "NA", "N.A.", "N/A", "NULL", "NaN", "\\N", "None", "null", "nan", "Na")


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column_name, n_rows, n_missing, n_distinct, missing_ratio`` in one pass."""
    blank = lambda c: F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""))
    one = df.agg(F.count("*").alias("n_rows"), *[blank(c).alias(f"m_{c}") for c in columns], *[F.count_distinct(c).alias(f"d_{c}") for c in columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"m_{c}").alias("n_missing"), F.col(f"d_{c}").alias("n_distinct")) for c in columns]))
    flat = one.select("n_rows", rows.alias("r")).select("r.column_name", "n_rows", "r.n_missing", "r.n_distinct")
    return flat.withColumn("missing_ratio", F.round(F.col("n_missing") / F.col("n_rows"), 4))


def token_counts(df: DataFrame, columns: Sequence[str], tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """``column_name, token, n`` with zeros, all columns in one pass. A null counts as the empty token."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("token")) for c in columns])).alias("r"))
    seen = long.select("r.*").where(F.col("token").isin(*tokens)).groupBy("column_name", "token").agg(F.count("*").alias("n"))
    spark = df.sparkSession
    grid = spark.createDataFrame([(c, t) for c in columns for t in tokens], "column_name string, token string")
    return grid.join(seen, ["column_name", "token"], "left").fillna(0, ["n"])


def token_parity(stages: dict[str, DataFrame], columns: Sequence[str], tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """Counts per stage side by side and whether tokens were lost or added from the first stage to the last."""
    out, names = None, list(stages)
    for name, df in stages.items():
        have = [c for c in columns if c in df.columns]
        t = token_counts(df, have, tokens).withColumnRenamed("n", f"n_{name}")
        out = t if out is None else out.join(t, ["column_name", "token"], "full")
    out = out.fillna(0)
    first, last = F.col(f"n_{names[0]}"), F.col(f"n_{names[-1]}")
    return out.withColumns({"lost": last < first, "added": last > first})


def with_all(counts: DataFrame, keys: dict[str, Sequence[str]], value: str = "n") -> DataFrame:
    """``counts`` with a zero for every missing combination of the fixed categories."""
    spark, grid = counts.sparkSession, None
    for name, values in keys.items():
        side = spark.createDataFrame([(v,) for v in values], f"`{name}` string")
        grid = side if grid is None else grid.crossJoin(side)  # products of fixed lists, not of rows
    return grid.join(counts, list(keys), "left").fillna(0, [value])


def share_of_all(df: DataFrame, value: str, out: str = "share") -> DataFrame:
    total = df.agg(F.sum(value).alias("_all"))
    return df.join(F.broadcast(total)).withColumn(out, F.col(value) / F.col("_all")).drop("_all")


def duplicate_groups(df: DataFrame, key: Column | str, name: str = "key") -> DataFrame:
    """``name, n`` of keys that occur more than once."""
    k = F.col(key) if isinstance(key, str) else key
    return df.select(k.alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n")).where("n > 1")


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side that the other lacks, repeated rows counted, marked by side."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def constant_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """(empty columns, columns with a single value), from one aggregate."""
    row = df.agg(*[F.count(c).alias(f"n_{c}") for c in df.columns], *[F.approx_count_distinct(c).alias(f"a_{c}") for c in df.columns],
                 *[F.min(F.col(c).cast("string")).alias(f"lo_{c}") for c in df.columns], *[F.max(F.col(c).cast("string")).alias(f"hi_{c}") for c in df.columns]).first()
    empty = [c for c in df.columns if row[f"n_{c}"] == 0]
    return empty, [c for c in df.columns if row[f"n_{c}"] and row[f"lo_{c}"] == row[f"hi_{c}"]]


def loess(df: DataFrame, group: str, x: str, y: str, span: float = 0.75) -> DataFrame:
    """Local linear regression (tricube weights) of y on x at every x of each group.

    The groups are summary series (years); one task per group.
    """
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(x)
        xs, ys = pdf[x].to_numpy(float), pdf[y].to_numpy(float)
        k = min(len(xs), max(2, int(np.ceil(span * len(xs)))))
        smooth = []
        for v in xs:
            d = np.abs(xs - v)
            reach = max(np.sort(d)[k - 1] * max(1.0, span), 1e-12)
            w = np.clip(1 - (d / reach) ** 3, 0, None) ** 3
            mx, my = np.average(xs, weights=w), np.average(ys, weights=w)
            var = np.average((xs - mx) ** 2, weights=w)
            slope = np.average((xs - mx) * (ys - my), weights=w) / var if var > 1e-12 else 0.0
            smooth.append(my + slope * (v - mx))
        return pd.DataFrame({group: pdf[group], x: xs, "smooth": smooth})

    kind = dict(df.dtypes)[group]
    return df.select(group, x, y).dropna().groupBy(group).applyInPandas(fit, f"`{group}` {kind}, `{x}` double, smooth double")


def reconciled(figures: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """``figure, n_whole, n_parts``: two one-row counts ``n`` of each figure side by side, by union and one aggregate."""
    out = None
    for name, sides in figures.items():
        for k, side in enumerate(sides):
            row = side.select(F.lit(name).alias("figure"), F.lit(k).alias("_k"), F.col("n").cast("bigint").alias("_n"))
            out = row if out is None else out.unionByName(row)
    pick = lambda k: F.coalesce(F.max(F.when(F.col("_k") == k, F.col("_n"))), F.lit(0))
    return out.groupBy("figure").agg(pick(0).alias("n_whole"), pick(1).alias("n_parts"))


def reconcile(checks: dict[str, tuple[int, int]]) -> None:
    """Raise unless both figures of every check agree (driver side)."""
    wrong = {k: v for k, v in checks.items() if v[0] != v[1]}
    if wrong:
        raise ValueError(f"figures that don't reconcile: {wrong}")
