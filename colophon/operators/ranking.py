"""One row per key, best first; what changed between versions; samples by hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_latest(df: DataFrame, key: str, order: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """(kept, others): the first row of each key in the given order, and the rest with the row's rank."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank"), ranked.where("_rank > 1").withColumnRenamed("_rank", "version_rank")


def changed_columns(old: DataFrame, kept: DataFrame, key: str, row_id: str, compare: Sequence[str]) -> DataFrame:
    """``row_id``, ``key``, ``changed``: sorted names of the columns whose trimmed text differs from the kept row, else ``none``."""
    new = kept.select(key, *[F.col(c).alias(f"_new_{c}") for c in compare])
    text = lambda c: F.trim(F.col(c).cast("string"))
    marks = F.array(*[F.when(~text(c).eqNullSafe(text(f"_new_{c}")), F.lit(c)) for c in sorted(compare)])
    names = F.array_join(F.filter(marks, lambda m: m.isNotNull()), ",")
    return old.join(new, key).select(row_id, key, F.when(names == "", "none").otherwise(names).alias("changed"))


def best_per_key(df: DataFrame, key: str, value: Column, order: Column, name: str) -> DataFrame:
    """``key`` and the value of the smallest order; partial aggregation, no sort."""
    return df.groupBy(key).agg(F.min_by(value, order).alias(name))


def hash_order(seed: int, *keys: str) -> Column:
    """A fixed random-looking order that doesn't depend on partitions."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def stratified_sample(df: DataFrame, stratum: str, key: str, size: int, seed: int = 0) -> DataFrame:
    """At most ``size`` rows of each stratum, the first by hash."""
    w = Window.partitionBy(stratum).orderBy(hash_order(seed, key))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= size).drop("_r")


def quota_sample(df: DataFrame, stratum: str, key: str, quotas: dict[str, int], seed: int = 0) -> DataFrame:
    """As many rows of each stratum as its quota says; others have none."""
    quota = F.coalesce(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])[F.col(stratum)], F.lit(0))
    w = Window.partitionBy(stratum).orderBy(hash_order(seed, key))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= quota).drop("_r")


def fixed_sample(df: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """``size`` rows by hash order; a top-k, not a full sort."""
    return df.orderBy(hash_order(seed, key), key).limit(size)
