"""Filling containers of fixed capacity with texts, by cost.

Cost-balanced packing: a text of n tokens costs ``LINEAR`` n + ``QUADRATIC`` n²
(attention stays within a text). In descending order each text goes to the
sequence of the least cost that still has room; when none has, a new one is
begun. As many sequences as the tokens fill at least are open from the start, so
that costs are balanced and the small texts that come last fill the gaps.

A text is split only if it exceeds the capacity: into full pieces, which are
sequences of their own, and a rest that is packed like any other.

Items are spread by hash over shards of about ``SHARD`` items, each packed in one
task: no shard grows with the input, and each is a fair sample of the sizes, so
that the space left unused is the same as in one large packing but for the last
sequences of a shard.

Defined results: null and empty texts (no tokens) aren't packed; ties in size go
by key; repeated texts are packed as often as they come; an empty table gives an
empty result; the texts themselves aren't shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINEAR, QUADRATIC = 1.0, 1.0 / 2048
SHARD, MOST_KINDS = 4000, 1000
PACKED = "container_kind string, capacity_tokens int, shard bigint, container_no int, doc_id bigint, piece_no int, first_token bigint, n_tokens bigint"


def assign(sizes: np.ndarray, capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> np.ndarray:
    """Sequence number of each size (all at most the capacity), in the order given."""
    order = np.argsort(-sizes, kind="stable")
    out = np.zeros(len(sizes), np.int64)
    if not len(sizes):
        return out
    least = int(-(-sizes.sum() // capacity))
    room = np.zeros(least + len(sizes), np.int64)
    room[:least] = capacity
    cost = np.zeros(len(room))
    n = least
    for i in order:
        size = sizes[i]
        fits = np.flatnonzero(room[:n] >= size)
        if len(fits):
            j = fits[cost[fits].argmin()]
        else:
            j = n
            room[j] = capacity
            n += 1
        room[j] -= size
        cost[j] += linear * size + quadratic * float(size) * size
        out[i] = j
    return np.unique(out, return_inverse=True)[1]


def pieces(sizes: DataFrame, key: str, containers: DataFrame) -> DataFrame:
    """One row per container kind and piece: ``key, piece_no, first_token, n_tokens``.

    The kinds are a small fixed list, written into the plan as literals; one of more than ``MOST_KINDS`` is refused.
    """
    kinds = containers.select("container_kind", F.col("capacity_tokens").cast("int").alias("capacity_tokens")).where("capacity_tokens > 0").distinct()
    rows = sorted(kinds.limit(MOST_KINDS + 1).collect(), key=lambda r: (str(r[0]), r[1]))
    if len(rows) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of containers")
    entry = lambda kind, capacity: F.struct(F.lit(kind).cast("string").alias("container_kind"), F.lit(capacity).cast("int").alias("capacity_tokens"))
    each = F.explode(F.array(*[entry(*r) for r in rows] or [entry(None, 1)]))
    items = sizes.where("n_tokens > 0" if rows else "false").select(key, "n_tokens", each.alias("_kind")).select(key, "n_tokens", "_kind.*")
    last = F.floor((F.col("n_tokens") - 1) / F.col("capacity_tokens")).cast("int")
    cut = items.select("container_kind", "capacity_tokens", key, F.col("n_tokens").alias("_n"), F.explode(F.sequence(F.lit(0), last)).alias("piece_no"))
    first = F.col("piece_no").cast("bigint") * F.col("capacity_tokens")
    return cut.select(
        "container_kind", "capacity_tokens", key, "piece_no", first.alias("first_token"),
        F.least(F.col("_n") - first, F.col("capacity_tokens").cast("bigint")).alias("n_tokens"),
    )


def pack(sizes: DataFrame, key: str, containers: DataFrame, shard: int = SHARD) -> DataFrame:
    """``PACKED`` rows: which piece of which text lies in which container.

    ``sizes``: ``key`` and ``n_tokens``, kept where they are read twice.
    """
    rest = pieces(sizes, key, containers)
    n_shards = max(1, -(-sizes.count() // shard))
    spread = rest.withColumn("shard", F.pmod(F.xxhash64(key, "piece_no"), F.lit(n_shards)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([key, "piece_no"], ignore_index=True)
        capacity = int(pdf["capacity_tokens"].iloc[0])
        size = pdf["n_tokens"].to_numpy()
        full = size == capacity
        no = np.zeros(len(pdf), np.int64)
        no[~full] = assign(size[~full], capacity)
        no[full] = no[~full].max(initial=-1) + 1 + np.arange(full.sum())
        return pdf.assign(container_no=no.astype(np.int32), doc_id=pdf[key])[[c.split()[0] for c in PACKED.split(", ")]]

    return spread.groupBy("container_kind", "capacity_tokens", "shard").applyInPandas(run, PACKED)


def report(packed: DataFrame) -> DataFrame:
    """Per kind: containers, texts, tokens, share of the space used, balance of costs."""
    cost = LINEAR * F.col("n_tokens") + QUADRATIC * F.col("n_tokens").cast("double") * F.col("n_tokens")
    by = packed.groupBy("container_kind", "capacity_tokens", "shard", "container_no").agg(F.sum("n_tokens").alias("used"), F.sum(cost).alias("cost"), F.count("*").alias("n"))
    return by.groupBy("container_kind", "capacity_tokens").agg(
        F.count("*").alias("n_containers"), F.sum("n").alias("n_pieces"), F.sum("used").alias("n_tokens"),
        (F.sum("used") / (F.count("*") * F.first("capacity_tokens"))).alias("share_used"),
        F.max("used").alias("most_used"), (F.stddev_pop("cost") / F.avg("cost")).alias("cost_spread"),
    )
