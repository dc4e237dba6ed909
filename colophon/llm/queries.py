"""Queries of the training-data problems over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.llm import canonical_list as cl
from colophon.llm import container_packing as cp
from colophon.llm import encoding_repair as er
from colophon.llm import format_dedup as fd
from colophon.llm import language_labels as ll
from colophon.llm import personal_information as pi
from colophon.llm import source_mixing as sm
from colophon.llm.token_sizes import token_sizes
from colophon.operators.value_splitter import split_values
from colophon.session import spread, table, written

MERGED = "dimension_merged"
ENTRIES = ("concepts_scores", "researchers", "authors", "referenced_pubs", "category_for")
PLAIN = (
    "id", "title", "journal_title", "publisher", "times_cited", "date", "year", "research_org_country_names", "research_org_names",
    "research_org_types", "concepts", "issn", "isbn", "open_access", "document_type", "type", "authors_count", "reference_ids", "language",
)


def _hashed(spark: SparkSession, d: str) -> DataFrame:
    return fd.keyed(spread(table(spark, d, MERGED).select("rec_no", "doi", *PLAIN, *ENTRIES)), "rec_no", fd.canonical(PLAIN, ENTRIES, ["doi"]))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = fd.copies(_hashed(spark, d), "rec_no")
    return pairs.select(F.col("first_key").alias("rec_no_a"), F.col("rec_no").alias("rec_no_b"))


def p5_collapsed(spark: SparkSession, d: str) -> DataFrame:
    kept = fd.groups(_hashed(spark, d), "rec_no")
    return kept.select(F.col("first_key").alias("rec_no"), "n_copies")


def p5_collisions(spark: SparkSession, d: str) -> DataFrame:
    return fd.collisions(fd.groups(_hashed(spark, d), "rec_no")).select(F.hex("h128").alias("h128"), "n_records")


def _institutions(spark: SparkSession, d: str) -> DataFrame:
    """``rec_no``, ``item``, ``inst_id`` (0: unlisted) of every name in every cell."""
    shards = cl.reference(table(spark, d, "institution_ranking"), "inst_id", "institution")
    names = split_values(table(spark, d, MERGED), "rec_no", "research_org_names")
    return cl.map_names(names, ["rec_no"], "item", shards, "inst_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _institutions(spark, d).select("rec_no", "inst_id").distinct()


def p3_unlisted(spark: SparkSession, d: str) -> DataFrame:
    names = _institutions(spark, d).where("inst_id = 0")
    return names.groupBy("item").agg(F.count("*").alias("n_names"), F.min("rec_no").alias("first_rec_no"))


LANGUAGE_SAMPLE = "sample_records_language_title_abstract"


def p2_segments(spark: SparkSession, d: str) -> DataFrame:
    sample, codes = table(spark, d, LANGUAGE_SAMPLE), table(spark, d, "language_codes")
    return ll.label_texts(sample, "id", ["title", "abstract"], ["abstract"], codes)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    codes = table(spark, d, "language_codes")
    found = p2_segments(spark, d)
    names = ("language", "pred_lang_title", "pred_lang_abstract")
    labels = table(spark, d, LANGUAGE_SAMPLE).select("id", *[ll.named(F.col(c), codes).alias(c) for c in names])
    mixed = found.where("n_segs > 1").select("id", "field_name", "seg_no", "lang_code")
    one = found.where("n_segs = 1").join(labels, "id")
    held = F.when(F.col("field_name") == "title", F.array(F.lit("pred_lang_title"))).otherwise(
        F.array(F.lit("language"), F.lit("pred_lang_abstract"))
    )
    said = F.coalesce(*[F.when(F.col("name") == c, F.col(c)) for c in names])
    wrong = one.withColumn("name", F.explode(held)).where(~said.eqNullSafe(F.col("lang_code")))
    return mixed.unionByName(wrong.select("id", F.col("name").alias("field_name"), F.lit(0).alias("seg_no"), "lang_code")).distinct()


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    return er.repair(table(spark, d, LANGUAGE_SAMPLE), "id", ["title", "abstract"]).drop("text_md5")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    fixed = er.repair(table(spark, d, LANGUAGE_SAMPLE), "id", ["title", "abstract"])
    return fixed.select("id", "field_name", "text_md5").distinct()


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return pi.accepted(pi.extract(table(spark, d, "documents"), "doc_id", "text"), "doc_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _cases(spark, d).select("doc_id", F.col("kind").alias("pii_kind"), F.col("text").alias("pii_text")).distinct()


def p10_masked(spark: SparkSession, d: str) -> DataFrame:
    return pi.mask(table(spark, d, "documents"), "doc_id", "text", _cases(spark, d))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = written(token_sizes(table(spark, d, "documents"), "text", keep=("doc_id",)))
    return cp.pack(sizes, "doc_id", table(spark, d, "container_sizes"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return cp.report(p8_packed(spark, d))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, list[dict], DataFrame]:
    sizes = token_sizes(table(spark, d, "documents"), "text", keep=("doc_id", "source")).where("n_tokens > 0")
    sized = written(sizes.select("doc_id", sm.source_name(F.col("source")).alias("source"), "n_tokens", sm.bucket("doc_id").alias("bucket")))
    planned = sm.plan(sized, table(spark, d, "source_targets"))
    return sm.mix(sized, "doc_id", planned), planned, sized


def p9_mixed(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return sm.shares(*_mixed(spark, d))


QUERIES = {
    "p2_found": p2_found, "p2_segments": p2_segments, "p3_found": p3_found, "p3_unlisted": p3_unlisted, "p4_found": p4_found, "p4_repaired": p4_repaired,
    "p8_packed": p8_packed, "p8_report": p8_report, "p9_mixed": p9_mixed, "p9_shares": p9_shares,
    "p10_found": p10_found, "p10_masked": p10_masked, "p5_found": p5_found, "p5_collapsed": p5_collapsed, "p5_collisions": p5_collisions,
}
SQL: dict[str, str] = {
    "p5_collisions": "select '' as h128, cast(0 as bigint) as n_records where false",  # different records never share 128 bits
}
