"""Joins on several keys at once, coverage, and near matches of names."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colophon.functions.measures import match_status


def shared_key_match(left: DataFrame, key: str, left_keys: Column, right: DataFrame, right_id: str, right_keys: Column) -> DataFrame:
    """``key``, ``status``, ``matched_keys``, ``candidate_ids``: all candidates that share any key.

    Both sides are exploded and joined by equality; no left row is lost. The
    lists are sorted and joined by bars.
    """
    l = left.select(F.col(key).alias("_l"), F.array_distinct(left_keys).alias("_ks"))  # noqa: E741
    r = right.select(F.col(right_id).alias("_r"), F.explode(F.array_distinct(right_keys)).alias("_k")).distinct()
    pairs = l.select("_l", F.explode("_ks").alias("_k")).join(r, "_k")
    hits = pairs.groupBy("_l").agg(F.collect_set("_k").alias("_m"), F.collect_set("_r").alias("_c"))
    both = l.join(hits, "_l", "left")
    n = F.coalesce(F.size("_c"), F.lit(0))
    joined = lambda c: F.coalesce(F.array_join(F.array_sort(F.transform(F.col(c), lambda v: v.cast("string"))), "|"), F.lit(""))
    return both.select(
        F.col("_l").alias(key), match_status(F.size("_ks") > 0, F.when(n < 0, 0).otherwise(n)).alias("status"),
        joined("_m").alias("matched_keys"), joined("_c").alias("candidate_ids"),
    )


def covered_by_any(left: DataFrame, key: str, tests: list[tuple[Column, DataFrame, Column]]) -> DataFrame:
    """``key`` and ``covered``: does any of several keys (a value or an array) occur on the other side."""
    out = None
    for mine, other, theirs in tests:
        theirs_set = other.select(F.explode(theirs).alias("_k")).where(F.col("_k").isNotNull()).distinct()
        hit = left.select(F.col(key), F.explode(mine).alias("_k")).join(theirs_set, "_k", "left_semi").select(key)
        out = hit if out is None else out.unionByName(hit)
    return left.select(key).join(out.distinct().withColumn("_hit", F.lit(True)), key, "left").select(key, F.coalesce("_hit", F.lit(False)).alias("covered"))


def indel_ratio(a: str, b: str) -> float:
    """200 x length of the longest common subsequence / sum of the lengths."""
    if not a or not b:
        return 0.0
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            keep = row[j]
            row[j] = last + 1 if x == y else max(row[j], row[j - 1])
            last = keep
    return 200.0 * row[-1] / (len(a) + len(b))


def near_match(left: DataFrame, key: str, name: str, listed: DataFrame, entry: str, least: float = 92.0) -> DataFrame:
    """Best entry of a list per name with an Indel ratio of ``least`` or more: ``key, name, entry, ratio``.

    Distinct names meet entries through shared trigrams, which every pair of such
    a ratio has if the texts have six characters or more; shorter ones meet by
    their first character. No pairs beyond those are formed.
    """
    def blocks(c: str) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - 2)), lambda i: F.substring(F.col(c), i, F.lit(3)))
        return F.array_distinct(F.when(F.length(c) >= 6, grams).otherwise(F.array(F.concat(F.lit("^"), F.substring(c, 1, 1)))))

    names = left.select(F.col(name).alias("_n")).where("_n != ''").distinct()
    entries = listed.select(F.col(entry).alias("_e")).where("_e != ''").distinct()
    pairs = (
        names.select("_n", F.explode(blocks("_n")).alias("_b"))
        .join(entries.select("_e", F.explode(blocks("_e")).alias("_b")), "_b")
        .groupBy("_n", "_e").agg(F.count("*").alias("_shared"))
    )
    # with a ratio r the lengths differ by no more than this
    lo, hi = F.least(F.length("_n"), F.length("_e")), F.greatest(F.length("_n"), F.length("_e"))
    pairs = pairs.where(200.0 * lo >= least * (lo + hi))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ratio = [indel_ratio(x, y) for x, y in zip(b["_n"], b["_e"], strict=True)]
            yield pd.DataFrame({"_n": b["_n"], "_e": b["_e"], "ratio": pd.Series(ratio, dtype="float64")})

    scored = pairs.select("_n", "_e").mapInPandas(score, "_n string, _e string, ratio double").where(F.col("ratio") >= least)
    best = scored.groupBy("_n").agg(F.max_by(F.struct("_e", "ratio"), F.struct("ratio", F.col("_e"))).alias("_best"))
    return left.join(best, left[name] == best["_n"]).select(key, name, F.col("_best._e").alias("entry"), F.col("_best.ratio").alias("ratio"))


def expand_candidates(matched: DataFrame, key: str, ids: Column, candidates: DataFrame, cid: str, fields: list[str]) -> DataFrame:
    """``key``, each field if there is exactly one candidate, and all candidates as JSON if there are more."""
    rows = matched.select(key, F.size(ids).alias("_n"), F.explode_outer(ids).alias("_c"))
    full = rows.join(candidates.select(F.col(cid).cast("string").alias("_c"), *fields), "_c", "left")
    packed = full.groupBy(key).agg(
        F.max("_n").alias("_n"), F.sort_array(F.collect_list(F.struct(F.col("_c").alias(cid), *fields))).alias("_all")
    )
    one = [F.when(F.col("_n") == 1, F.get("_all", F.lit(0))[f]).alias(f) for f in fields]
    return packed.select(key, *one, F.when(F.col("_n") > 1, F.to_json("_all")).alias("candidates_json"))
