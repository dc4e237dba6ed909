import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colophon.llm import container_packing as cp
from colophon.llm import queries
from colophon.llm import source_mixing as sm
from colophon.llm import token_sizes as ts

needs_vocabulary = pytest.mark.skipif(not os.path.exists(ts.VOCABULARY), reason="no vocabulary here")


@needs_vocabulary
@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\tab'sé日1.,-—", max_size=40))
def test_counts_are_exact(text):
    assert ts.Counts(ts.VOCABULARY).of(text) == len(ts.encoding(ts.VOCABULARY).encode_ordinary(text))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_assignment_holds_every_item_once(sizes):
    no = cp.assign(np.array(sizes, np.int64), 100)
    used = np.bincount(no, np.array(sizes, float)) if sizes else np.zeros(0)
    assert len(no) == len(sizes) and (used <= 100).all() and (used > 0).all()


def test_packing(spark):
    sizes = spark.range(5000).select(F.col("id").alias("doc_id"), (F.pmod(F.xxhash64("id"), F.lit(900)) + 1).alias("n_tokens"))
    sizes = sizes.union(spark.sql("select -1L, 2500L union all select -2L, 0L union all select -3L, null"))
    kinds = spark.createDataFrame([("small", 512), ("wide", 4096)], "container_kind string, capacity_tokens int")
    packed = cp.pack(sizes, "doc_id", kinds, 700).cache()
    total = sizes.agg(F.sum("n_tokens")).first()[0]
    rows = {r["container_kind"]: r for r in cp.report(packed).collect()}
    for kind, cap in (("small", 512), ("wide", 4096)):
        assert rows[kind]["n_tokens"] == total and rows[kind]["most_used"] <= cap and rows[kind]["share_used"] > 0.9
    cut = packed.groupBy("container_kind", "doc_id").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).where("n > 1").collect()
    assert all(r["t"] > 512 for r in cut if r["container_kind"] == "small") and not [r for r in cut if r["container_kind"] == "wide"]
    big = packed.where("doc_id = -1 and container_kind = 'small'").orderBy("piece_no").collect()
    assert [(r["first_token"], r["n_tokens"]) for r in big] == [(0, 512), (512, 512), (1024, 512), (1536, 512), (2048, 452)]
    assert cp.pack(sizes.limit(0), "doc_id", kinds).count() == 0 == cp.pack(sizes, "doc_id", kinds.limit(0)).count()
    with pytest.raises(ValueError, match="kinds"):
        cp.pieces(sizes, "doc_id", spark.range(1001).selectExpr("string(id) as container_kind", "1 as capacity_tokens"))


def test_water_filling():
    got = sm.water_fill({"a": 100, "b": 1000, "c": 10}, {"a": 0.5, "b": 0.4, "c": 0.1}, {"a": 2, "b": 1, "c": 3}, 500)
    assert got["a"] == 200 and got["c"] == 30 and got["b"] == pytest.approx(270)
    assert sm.water_fill({"a": 1.0}, {"a": 1.0}, {"a": 2}, 500) == {"a": 2.0}
    assert sm.water_fill({}, {"a": 1.0}, {"a": 2}, 500) == {"a": 0.0}


def test_mixing(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "A-b ").when(F.col("id") % 3 == 1, "c").otherwise(None).alias("source"), (F.pmod(F.xxhash64("id"), F.lit(50)) + 1).alias("n_tokens"))
    sized = docs.select("doc_id", sm.source_name(F.col("source")).alias("source"), "n_tokens", sm.bucket("doc_id").alias("bucket")).cache()
    targets = spark.createDataFrame([("m", "a_b", 0.8, 2), ("m", "c", 0.2, 1), ("m", "gone", 0.0, 5)], "mix_name string, source string, target_share double, max_repeats int")
    planned = sm.plan(sized, targets)
    mixed = sm.mix(sized, "doc_id", planned)
    rows = {r["source"]: r for r in sm.shares(mixed, planned).collect()}
    whole = {r["source"]: r for r in sm.shares(mixed, planned, sized).collect()}
    assert whole[None]["source_tokens"] == docs.where("source is null").agg(F.sum("n_tokens")).first()[0] and {k: v for k, v in whole.items() if k} == rows
    assert rows["a_b"]["reached_share"] == pytest.approx(0.8, abs=0.002) and rows["c"]["reached_share"] == pytest.approx(0.2, abs=0.002)
    assert mixed.agg(F.max("n_repeats")).first()[0] == 2 and rows["gone"]["n_texts"] == 0
    again = {(r["doc_id"], r["n_repeats"]) for r in sm.mix(sized.repartition(3), "doc_id", planned).collect()}
    assert again == {(r["doc_id"], r["n_repeats"]) for r in mixed.collect()}
    assert sm.plan(sized.limit(0), targets)[0]["whole"] == 0


@needs_vocabulary
def test_p8_p9_on_tables(spark, sf):
    report = queries.p8_report(spark, sf).collect()
    assert len(report) == 4 and all(r["share_used"] > 0.8 and r["most_used"] <= r["capacity_tokens"] for r in report)
    shares = queries.p9_shares(spark, sf).collect()
    assert all(r["most_repeats"] <= r["max_repeats"] for r in shares)
    assert max(abs(r["reached_share"] - r["planned_share"]) for r in shares) < 0.15
