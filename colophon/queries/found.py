"""Queries of the general problems 1, 6 and 7 over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.operators import record_tokenizer as rt
from colophon.operators import schema_drift as sd
from colophon.operators import value_splitter as vs
from colophon.session import table

RECORD = ("id", "doi", "title", "times_cited", "year", "concepts", "issn", "type")
RAW, MERGED, SJR = "dimension_raw_lines", "dimension_merged", "scimagojr_communication_journal_1999_2024"
#: The columns of the consistent table of works, by the names of the first files.
WORK = {
    "display_name": "string", "publication_year": "integer", "publication_date": "date", "created_date": "date", "language": "string",
    "source_display_name": "string", "cited_by_count": "integer", "authors_count": "integer", "referenced_works_count": "integer",
    "first_page": "integer", "fwci": "decimal", "apc_paid": "decimal", "is_oa": "boolean", "is_retracted": "boolean",
}


MOST_RENAMES = 10_000


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return rt.parse_records(table(spark, d, RAW), "line_id", "raw_line", RECORD, counts=["times_cited"], lists=["concepts"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    raw = rt.rejected(_parsed(spark, d), "line_id").select(F.lit(RAW).alias("src_table"), F.col("line_id").alias("row_id"), "reason")
    fields = rt.validate_fields(table(spark, d, MERGED), "rec_no", counts=["times_cited"], lists=["concepts"])
    merged = rt.rejected(fields, "rec_no").select(F.lit(MERGED).alias("src_table"), F.col("rec_no").alias("row_id"), "reason")
    return raw.unionByName(merged)


def p1_loaded(spark: SparkSession, d: str) -> DataFrame:
    good = rt.accepted(_parsed(spark, d), ["times_cited"], ["concepts"])
    return good.withColumns({"concepts": F.array_join("concepts", "|"), "year": F.expr("try_cast(year as int)")})


def p1_rejected(spark: SparkSession, d: str) -> DataFrame:
    return rt.rejected(_parsed(spark, d), "line_id")


def _p6(spark: SparkSession, d: str) -> DataFrame:
    """``src_table, row_id, field_name, n_items, pos_no, item`` of all packed fields; each table is split in one go."""
    merged = vs.split_fields(table(spark, d, MERGED), "rec_no", ("research_org_names", "research_org_country_names"), codes=("issn",), whole=("-",))
    sjr = vs.split_fields(table(spark, d, SJR), "row_no", (), codes=("issn",), whole=("-",))
    both = [(MERGED, merged.withColumnRenamed("rec_no", "row_id")), (SJR, sjr.withColumnRenamed("row_no", "row_id"))]
    rows = [items.select(F.lit(name).alias("src_table"), "row_id", "field_name", "n_items", "pos_no", "item") for name, items in both]
    return rows[0].unionByName(rows[1])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _p6(spark, d).where(F.col("n_items") > 1).drop("n_items")


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return _p6(spark, d).groupBy("src_table", "field_name", "n_items").agg(F.count("*").alias("n_values"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return sd.detect_changes(table(spark, d, "openalex_file_lines"))


def _approved(spark: SparkSession, d: str) -> dict[str, str]:
    """Renames found, as field -> target column. Header names, so a few dozen however long the table is; more than ``MOST_RENAMES`` are refused."""
    seen = p7_found(spark, d).where(F.col("change_kind") == "renamed").groupBy("column_name", "new_name").count()
    rows = seen.orderBy(F.desc("count"), "column_name", "new_name").limit(MOST_RENAMES + 1).collect()
    if len(rows) > MOST_RENAMES:
        raise ValueError(f"more than {MOST_RENAMES} different renames")
    out: dict[str, str] = {c: c for c in WORK}
    for _ in WORK:
        for r in rows:
            if r["column_name"] in out:
                out.setdefault(r["new_name"], out[r["column_name"]])
    return {f: c for f, c in out.items() if f != c}


def p7_table(spark: SparkSession, d: str) -> DataFrame:
    loaded = sd.ingest(table(spark, d, "openalex_file_lines"), WORK)
    full = sd.promote(loaded, _approved(spark, d))
    return full.withColumn("rescued", F.to_json("rescued"))


def p7_stats(spark: SparkSession, d: str) -> DataFrame:
    stats = sd.run_stats(table(spark, d, "openalex_file_lines"))
    return stats.withColumns({c: F.array_join(c, "|") for c in ("unique_columns", "differing_files")})


QUERIES = {
    "p1_found": p1_found, "p1_loaded": p1_loaded, "p1_rejected": p1_rejected, "p6_found": p6_found, "p6_counts": p6_counts,
    "p7_found": p7_found, "p7_table": p7_table, "p7_stats": p7_stats,
}

CELL = r'(?:"(?:[^"\\]|""|\\+[^\\])*"|[^",]*)'
LIST = r"""\s*\[\s*(?:(?:''(?:[^''\\]|\\.)*''|"(?:[^"\\]|\\.)*")(?:\s*,\s*(?:''(?:[^''\\]|\\.)*''|"(?:[^"\\]|\\.)*"))*)?\s*\]\s*"""
BAD_COUNT, BAD_LIST = "not regexp_full_match(trim(coalesce({0}, '')), '[0-9]*')", "trim(coalesce({0}, '')) <> '' and not regexp_full_match({0}, '(?s)" + LIST + "')"
TEXT = "case when {0} like '\"%' then regexp_replace(substr({0}, 2, length({0}) - 2), '\"\"|\\\\\"', '\"', 'g') else {0} end"
SQL = {
    "p1_found": f"""with w as (select line_id, regexp_full_match(raw_line, '(?s){CELL}(?:,{CELL})*') as ok, regexp_extract_all(raw_line, '(?s)(?:^|,)({CELL})', 1) as c
  from dimension_raw_lines), g as (select line_id, {TEXT.format('c[4]')} as t, {TEXT.format('c[6]')} as k from w where ok and len(c) = 8)
 select '{RAW}' as src_table, line_id as row_id, 'quoting' as reason from w where not ok
 union all select '{RAW}', line_id, 'column_count' from w where ok and len(c) <> 8
 union all select '{RAW}', line_id, 'times_cited' from g where {BAD_COUNT.format('t')} union all select '{RAW}', line_id, 'concepts' from g where {BAD_LIST.format('k')}
 union all select '{MERGED}', rec_no, 'times_cited' from {MERGED} where {BAD_COUNT.format('times_cited')}
 union all select '{MERGED}', rec_no, 'concepts' from {MERGED} where {BAD_LIST.format('concepts')}""",
    "p7_stats": """with h as (select run_id, file_id, file_name, file_date, list_sort(list_distinct(string_split(regexp_replace(lower(raw_line), '[\\s\\x{00A0}\\x{FEFF}"]', '', 'g'), ','))) as c
  from openalex_file_lines where line_no = 1), f as (select run_id, arg_min(c, (file_date, file_id)) as first from h group by 1),
 u as (select run_id, array_to_string(list_sort(list_distinct(flatten(list(c)))), '|') as unique_columns from h group by 1), n as (select run_id, count(*) filter (line_no > 1) as total_rows from openalex_file_lines group by 1)
 select h.run_id, count(*) as total_files, any_value(n.total_rows) as total_rows, any_value(u.unique_columns) as unique_columns, bool_and(h.c = f.first) as per_file_columns_same,
 coalesce(string_agg(case when h.c <> f.first then h.file_name end, '|' order by h.file_name), '') as differing_files from h join f using (run_id) join u using (run_id) join n using (run_id) group by h.run_id""",
}
