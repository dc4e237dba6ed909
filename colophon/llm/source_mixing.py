"""Mixing sources to target shares of the size, small sources repeated up to a cap.

Capped water-filling: each source is to give its share of the total; a source
whose repetitions would exceed its cap is clamped there, the weight it leaves
over goes to the others in proportion, until none exceeds its cap. Repetitions
are whole ones for every text and a fractional one for a seeded sample; the
sample's threshold is read off the sizes summed by hash, so that the shares
reached are close to those planned whatever the sizes of the texts.

The plan needs one number per source and hash bucket: at most ``BUCKETS`` rows
for each source that has a target. Defined results: texts of a null or unknown
source, or without tokens, are left out, and ``shares`` reports their tokens in a
row of each mix without a source; a source without texts leaves its share
to the others; targets are scaled to sum 1; if all sources are clamped the mix
is as large as the caps allow; spellings of a source (case, blanks, hyphens)
are one source.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096
SEED = 20_240_501
MOST_TARGETS = 100_000


def source_name(source: Column) -> Column:
    """One spelling of a source."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s-]+", "_")


def water_fill(sizes: Mapping[str, float], shares: Mapping[str, float], caps: Mapping[str, float], total: float) -> dict[str, float]:
    """Size each source gives. ``caps``: most repetitions of each source."""
    open_ = {s for s, w in shares.items() if w > 0 and sizes.get(s, 0) > 0 and caps.get(s, 0) > 0}
    given: dict[str, float] = {s: 0.0 for s in shares}
    left = float(total)
    while open_ and left > 0:
        weight = sum(shares[s] for s in open_)
        over = {s for s in open_ if shares[s] / weight * left >= caps[s] * sizes[s]}
        if not over:
            given |= {s: shares[s] / weight * left for s in open_}
            break
        for s in over:
            given[s] = caps[s] * sizes[s]
            left -= given[s]
        open_ -= over
    return given


def plan(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = SEED) -> list[dict]:
    """Per mix and source: shares, whole repetitions, and the buckets below ``upto`` that come once more.

    ``sized``: ``source, bucket, n_tokens`` of every text. Without a total, a mix
    is as large as its sources together.
    """
    goal = targets.select("mix_name", source_name(F.col("source")).alias("source"), "target_share", "max_repeats").limit(MOST_TARGETS + 1).collect()
    if len(goal) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    known = sorted({r["source"] for r in goal if r["source"]})
    sums = sized.where(F.col("source").isin(known)).groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n")).collect()
    by: dict[str, list[float]] = {s: [0.0] * BUCKETS for s in known}
    for r in sums:
        by[r["source"]][r["bucket"]] += r["n"]
    sizes = {s: sum(v) for s, v in by.items()}
    out = []
    for mix in sorted({r["mix_name"] for r in goal}):
        rows = [r for r in goal if r["mix_name"] == mix and r["source"]]
        shares = {r["source"]: float(r["target_share"] or 0) for r in rows}
        caps = {r["source"]: float(r["max_repeats"] or 0) for r in rows}
        total = total_tokens or sum(sizes.get(s, 0) for s in shares)
        given = water_fill(sizes, shares, caps, total)
        whole_share, whole = sum(shares.values()) or 1.0, sum(given.values()) or 1.0
        for s in sorted(shares):
            times = given[s] / sizes[s] if sizes.get(s) else 0.0
            rest, upto, seen = (times - int(times)) * sizes.get(s, 0), 0, 0.0
            while upto < BUCKETS and int(times) < caps[s] and abs(seen + by[s][upto] - rest) < abs(seen - rest) + (by[s][upto] == 0):
                seen += by[s][upto]
                upto += 1
            out.append(
                {"mix_name": mix, "source": s, "target_share": shares[s] / whole_share, "planned_share": given[s] / whole,
                 "max_repeats": int(caps[s]), "whole": int(times), "upto": upto if rest > 0 else 0, "source_tokens": int(sizes.get(s, 0))}
            )
    return out


def bucket(key: str, seed: int = SEED) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(BUCKETS)).cast("int")


def mix(sized: DataFrame, key: str, planned: list[dict]) -> DataFrame:
    """``mix_name, key, source, n_tokens, n_repeats`` of every text that is used."""
    spark = sized.sparkSession
    rows = [(p["mix_name"], p["source"], p["whole"], p["upto"]) for p in planned]
    steps = spark.createDataFrame(rows, "mix_name string, source string, whole int, upto int")
    used = sized.join(F.broadcast(steps), "source")
    repeats = F.col("whole") + (F.col("bucket") < F.col("upto")).cast("int")
    return used.select("mix_name", key, "source", "n_tokens", repeats.alias("n_repeats")).where("n_repeats > 0")


def shares(mixed: DataFrame, planned: list[dict], sized: DataFrame | None = None) -> DataFrame:
    """Per mix and source: target, planned and reached share, tokens, texts, repetitions; of ``sized`` also the tokens without a target."""
    spark = mixed.sparkSession
    rows = [(p["mix_name"], p["source"], p["target_share"], p["planned_share"], p["max_repeats"], p["source_tokens"]) for p in planned]
    goal = spark.createDataFrame(rows, "mix_name string, source string, target_share double, planned_share double, max_repeats int, source_tokens bigint")
    sums = mixed.groupBy("mix_name", "source").agg(
        F.sum(F.col("n_tokens") * F.col("n_repeats")).alias("mixed_tokens"), F.count("*").alias("n_texts"), F.max("n_repeats").alias("most_repeats")
    )
    all_ = sums.groupBy("mix_name").agg(F.sum("mixed_tokens").alias("_all"))
    full = goal.join(sums, ["mix_name", "source"], "left").join(all_, "mix_name", "left").fillna(0, ["mixed_tokens", "n_texts", "most_repeats"])
    full = full.withColumn("reached_share", F.coalesce(F.col("mixed_tokens") / F.col("_all"), F.lit(0.0))).drop("_all")
    if sized is None:
        return full
    none = lambda kind: F.lit(0).cast(kind)
    listed: dict[str, list[str]] = {}
    for p in planned:
        listed.setdefault(p["mix_name"], []).append(p["source"])
    left = {m: F.sum(F.when(F.col("source").isin(s), 0).otherwise(F.col("n_tokens"))) for m, s in listed.items()}
    one = sized.agg(*[F.coalesce(v, none("bigint")).alias(m) for m, v in left.items()]) if left else None
    if one is None:
        return full
    over = one.select(F.explode(F.array(*[F.struct(F.lit(m).alias("mix_name"), F.col(f"`{m}`").alias("source_tokens")) for m in left])).alias("r")).select("r.*")
    rest = over.select(
        "mix_name", F.lit(None).cast("string").alias("source"), none("double").alias("target_share"), none("double").alias("planned_share"), none("int").alias("max_repeats"),
        "source_tokens", none("bigint").alias("mixed_tokens"), none("bigint").alias("n_texts"), none("int").alias("most_repeats"), none("double").alias("reached_share"),
    )
    return full.unionByName(rest)
