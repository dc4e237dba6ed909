"""Further general operators over whole tables: scans, sinks, reshaping, overlays, reconciliation."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.functions import identifiers as fi
from colophon.functions import measures as fm
from colophon.functions import texts as ft
from colophon.functions.countries import with_country_code
from colophon.operators import documents as od
from colophon.operators import profiling as op
from colophon.operators import ranking as orank
from colophon.plans.variables import analysis_table
from colophon.queries import reference as ref
from colophon.session import shared_dir, table
from colophon.sources.databases import catalog
from colophon.sources.files import read_indicator
from colophon.sources.sinks import Files, write_verified

QUERIES: dict[str, ref.Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: ref.Query) -> ref.Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


merged, journals, SJR = ref.merged, ref.journals, ref.SJR


def scratch(s: SparkSession, name: str) -> str:
    return f"{shared_dir(s).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# -- scans and sinks: each writes a whole table in a format and reads it back ------------------------------------------------


def _csv(s: SparkSession, df: DataFrame, compression: str | None = None, **options: str) -> DataFrame:
    path = scratch(s, "csv")
    df.write.csv(path, header=True, escape='"', compression=compression, **options)
    return s.read.csv(path, schema=df.schema, header=True, multiLine=True, escape='"', **options)


RANKING = "select inst_id, global_rank, institution, country, sector from institution_ranking"


@query("s04_csv_strings", "select nullif(id, '') as id, nullif(title, '') as title, nullif(concepts, '') as concepts from dimension_merged")
def s04(s, d):
    """All strings, quotes and line breaks in cells, empty as null."""
    return _csv(s, merged(s, d).select("id", "title", "concepts"), ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false")


@query("s05_short_rows", "select inst_id, institution, null as missing from institution_ranking")
def s05(s, d):
    path = scratch(s, "short")
    table(s, d, "institution_ranking").select("inst_id", "institution").write.csv(path, header=True, escape='"')
    return s.read.csv(path, schema="inst_id bigint, institution string, missing string", header=True, escape='"', mode="PERMISSIVE")


@query("s06_inferred_types", "select region_key, region_name from (select r_regionkey as region_key, r_name as region_name from region)")
def s06(s, d):
    path = scratch(s, "infer")
    table(s, d, "region").select(F.col("r_regionkey").alias("region_key"), F.col("r_name").alias("region_name")).write.csv(path, header=True)
    return s.read.csv(path, header=True, inferSchema=True)


@query("s08_semicolons_fixed_schema", RANKING)
def s08(s, d):
    """A file with a separator and names of its own and a trailing placeholder column, which is dropped."""
    df = table(s, d, "institution_ranking")
    path = scratch(s, "semicolon")
    df.withColumn("_extra", F.lit("")).write.csv(path, header=True, sep=";", escape='"')
    return s.read.csv(path, schema=f"{df._jdf.schema().toDDL()}, _extra string", header=True, sep=";", escape='"').drop("_extra")


@query("s09_typed_conversion", f"select line_id, file_year, read_at from (select line_id, try_cast(list_last(regexp_extract_all(source_file, '(?:19|20)[0-9]{{2}}')) as int) as file_year, read_at from dimension_raw_lines)")
def s09(s, d):
    """Text to types in one pass; what doesn't cast is null."""
    text = table(s, d, "dimension_raw_lines").select(F.col("line_id").cast("string").alias("i"), "source_file", F.col("read_at").cast("string").alias("t"))
    return text.select(F.col("i").try_cast("bigint").alias("line_id"), ft.year_of_file(F.col("source_file")).alias("file_year"), F.col("t").try_cast("timestamp").alias("read_at"))


@query("s10_projected_scan", "select rec_no, year from dimension_merged where year = '2020'")
def s10(s, d):
    return merged(s, d).where("year = '2020'").select("rec_no", "year")


@query("s11_row_counts", " union all ".join(f"select '{t}' as table_name, count(*) as n from {t}" for t in ("dimension_merged", "documents", SJR, "lineitem")))
def s11(s, d):
    counts = [table(s, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n") for t in ("dimension_merged", "documents", SJR, "lineitem")]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


LISTED = ("customer", "dimension_merged", "documents", "language_codes", "orders")


@query("s13_catalog", "select table_name, column_name, not is_empty as has_example from duckdb_columns() join (" + " union all ".join(f"select '{t}' as table_name, count(*) = 0 as is_empty from {t}" for t in LISTED) + ") using (table_name)")
def s13(s, d):
    """Tables, their columns, and a row of each as example."""
    return catalog({t: table(s, d, t) for t in LISTED}).select("table_name", "column_name", F.col("example_row").isNotNull().alias("has_example"))


def _xml(s: SparkSession, d: str) -> DataFrame:
    """Dublin Core records made of the language sample."""
    esc = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    clean = lambda c: F.regexp_replace(esc(c), "[\u0000-\u0008\u000b\u000c\r\u000e-\u001f￾￿]", "")
    xml = F.concat(F.lit(f'<record xmlns:dc="{od.DC}"><dc:title>'), F.coalesce(clean("title"), F.lit("")), F.lit("</dc:title><dc:type>text</dc:type></record>"))
    return table(s, d, ref.SAMPLE).select("id", xml.alias("xml"))


@query("s14_oai_fields", f"select id, nullif(regexp_replace(title, '[\\x00-\\x08\\x0b\\x0c\\r\\x0e-\\x1f]', '', 'g'), '') as title, 'text' as type from {ref.SAMPLE}")
def s14(s, d):
    return od.oai_fields(_xml(s, d), "xml", ["title", "type"]).drop("xml")


@query("s15_tag_census", f"select 'dc:title' as tag, count(*) as n_documents from {ref.SAMPLE} union all select 'dc:type', count(*) from {ref.SAMPLE} union all select 'record', count(*) from {ref.SAMPLE}")
def s15(s, d):
    name = F.replace(F.col("tag"), F.lit("{" + od.DC + "}"), F.lit("dc:"))
    return od.tag_census(_xml(s, d), "id", "xml").select(name.alias("tag"), "n_documents")


@query("s22_json_by_year", "select event_id, event_type, cast(extract(year from ts) as int) as year from events")
def s22(s, d):
    path = scratch(s, "json")
    rows = table(s, d, "events").select("event_id", "event_type", F.year("ts").alias("year"))
    rows.write.partitionBy("year").json(path)
    return s.read.schema("event_id bigint, event_type string, year int").json(path)


def indicator_file(s: SparkSession, d: str) -> str:
    """A file as of an indicator's download, one row per country and year: here the mean rank of a country's institutions, growing by year."""
    path = scratch(s, "indicator")
    by = table(s, d, "institution_ranking").where("country is not null").groupBy("country").agg(F.avg("global_rank").alias("v"))
    years = F.explode(F.sequence(F.lit(2020), F.lit(2023))).alias("year")
    rows = with_country_code(by, "country", "iso2c").select("iso2c", "country", years, "v").withColumn("v", F.col("v") + F.col("year") - 2020)
    rows.withColumnRenamed("v", "XX.MEAN.RANK").write.csv(path, header=True)
    return path


@query("s24_indicator", f"select l.code as iso2c, country, 2022 as year, round(avg(global_rank) + 2, 6) as value from institution_ranking join {ref.ISO2_ROWS} on l.name = country group by all")
def s24(s, d):
    """One indicator of one year by country code."""
    return read_indicator(s, indicator_file(s, d), "XX.MEAN.RANK", 2022).withColumn("value", F.round("value", 6))


@query("k01_parquet_snappy", RANKING)
def k01(s, d):
    from colophon.sources.sinks import write_single

    return s.read.parquet(write_single(table(s, d, "institution_ranking"), scratch(s, "single")))


@query("k03_parquet_copy", f"select row_no, title, year from {SJR}")
def k03(s, d):
    path = scratch(s, "copy")
    journals(s, d).select("row_no", "title", "year").write.parquet(path, compression="zstd")
    return s.read.parquet(path)


@query("k05_verified_csv", "select rec_no, title, publisher, concepts from dimension_merged")
def k05(s, d):
    """Written as compressed CSV, read back, every cell compared, then put in place; any difference is an error."""
    path = scratch(s, "verified")
    df = merged(s, d).select("rec_no", "title", "publisher", "concepts")
    options = {"header": "true", "escape": '"', "multiLine": "true", "nullValue": "\\N", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    write_verified(df, path, "csv", compression="gzip", **options)
    return s.read.schema(df.schema).options(**options).csv(path)


@query("k02_union_csv", f"""select id, title, nullif(issn, '') as issn, part from (select nullif(id, '') as id, nullif(title, '') as title, null as issn, 'records' as part from dimension_merged union all select null, nullif(title, ''), issn, 'journals' from {SJR})""")
def k02(s, d):
    """Tables of differing columns as one CSV."""
    return _csv(s, ref.union_by_name(s, d).select("id", "title", "issn", "part"), ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false")


@query("k04_verified_parquet", "select rec_no, title, loaded_at from dimension_merged")
def k04(s, d):
    """Zstd Parquet, put in place once every cell read back is the same."""
    return s.read.parquet(write_verified(merged(s, d).select("rec_no", "title", "loaded_at"), scratch(s, "verified"), compression="zstd"))


@query("k07_stats_json", "select count(*) as total_rows, count(distinct source_file) as total_files, min(year) as first_year from dimension_merged")
def k07(s, d):
    """Statistics of a run as one JSON document."""
    stats = merged(s, d).agg(F.count("*").alias("total_rows"), F.count_distinct("source_file").alias("total_files"), F.min("year").alias("first_year")).first()
    path = scratch(s, "stats") + ".json"
    Files(s, path).write_text(json.dumps(stats.asDict(), indent=2), path)
    return s.read.json(path, schema="total_rows bigint, total_files bigint, first_year string", multiLine=True)


# -- reshaping ---------------------------------------------------------------------------------------------------------------


@query("p02_fixed_schema", "select rec_no, try_cast(authors_count as smallint) as authors_count, loaded_at from dimension_merged")
def p02(s, d):
    return merged(s, d).select("rec_no", F.col("authors_count").try_cast("smallint").alias("authors_count"), "loaded_at")


WANTED = ("rec_no", "issn", "issn_l", "source_issn", "type")


@query("p03_existing_columns", "select rec_no, issn, type from dimension_merged")
def p03(s, d):
    df = merged(s, d)
    return df.select(*[c for c in WANTED if c in df.columns])


@query("p04_block_order", "select year, date, rec_no, id from dimension_merged")
def p04(s, d):
    return merged(s, d).select("year", "date", "rec_no", "id")


@query("p09_clean_columns", f"select rank, title, type_name from (select rank, title, type as type_name from {SJR})")
def p09(s, d):
    """Names in snake case, empty and constant columns dropped."""
    df = journals(s, d).select(F.col("rank").alias("Rank"), F.col("title").alias("Title "), F.col("type").alias("Type.Name"), F.lit("x").alias("Same"), F.lit(None).cast("string").alias("None"))
    df = df.toDF(*[ft.snake_name(c) for c in df.columns])
    df = df.withColumn("type_name", F.col("type_name"))
    empty, same = op.constant_columns(df)
    return df.drop(*empty, *[c for c in same if c != "type_name"])


@query("p11_rename_drop", f"select id, language as language_db, title from {ref.SAMPLE}")
def p11(s, d):
    return table(s, d, ref.SAMPLE).withColumnRenamed("language", "language_db").drop("abstract", "pred_lang_title", "pred_lang_abstract")


@query("p14_explode", "select rec_no, unnest(regexp_extract_all(issn, '[0-9]{4}-[0-9]{3}[0-9X]')) as part from dimension_merged")
def p14(s, d):
    return merged(s, d).select("rec_no", F.explode(F.regexp_extract_all("issn", F.lit("([0-9]{4}-[0-9]{3}[0-9X])"), F.lit(1))).alias("part"))


@query("p15_separate_rows", "select rec_no, unnest(string_split(research_org_types, '; ')) as kind from dimension_merged")
def p15(s, d):
    return merged(s, d).select("rec_no", F.explode(F.split("research_org_types", "; ")).alias("kind"))


@query("p_unnest", "select rec_no, unnest(regexp_extract_all(category_for, 'QQid'': ''([0-9]+)', 1)) as category_id from dimension_merged".replace("QQ", "''"))
def p_unnest(s, d):
    """Elements of a parsed list; a record without any drops out."""
    parsed = ft.struct_list(F.col("category_for"), "id string, name string")
    return merged(s, d).select("rec_no", F.explode(parsed).alias("c")).select("rec_no", F.col("c.id").alias("category_id"))


@query("p_relocate", f"select title, year, row_no, sourceid from {SJR}")
def p_relocate(s, d):
    """Named columns to the front, all others after them in their order."""
    df = journals(s, d).select("row_no", "sourceid", "title", "year")
    front = ["title", "year"]
    return df.select(*front, *[c for c in df.columns if c not in front])


@query("p18_row_identity", f"select count(distinct (sourceid, title, year)) as n_identities from {SJR}")
def p18(s, d):
    return journals(s, d).select(F.struct("sourceid", "title", "year").alias("k")).distinct().agg(F.count("*").alias("n_identities"))


@query("p19_resolve_column", "select rec_no, issn as found from dimension_merged")
def p19(s, d):
    """The first of several candidate names that the table has, else one that contains a word."""
    return merged(s, d).select("rec_no", F.col(resolve(merged(s, d).columns, ("ISSN_L", "ISSN"), "issn")).alias("found"))


def resolve(columns: list[str], candidates: tuple[str, ...], word: str) -> str:
    lower = {c.lower(): c for c in columns}
    for c in candidates:
        if c.lower() in lower:
            return lower[c.lower()]
    for c in columns:
        if word in c.lower():
            return c
    raise KeyError(f"none of {candidates} in {columns}")


@query("w03_any_valid_issn", f"select distinct row_no from {ref.CHECKED} where {ref.STRICT} is not null")
def w03(s, d):
    return journals(s, d).where(~fi.is_missing(F.col("issn")) & (F.size(fi.issns_strict(F.col("issn"))) > 0)).select("row_no")


@query("w05_blank", f"select row_no from {SJR} where publisher is null or trim(publisher) = ''")
def w05(s, d):
    return journals(s, d).where(F.col("publisher").isNull() | (F.trim("publisher") == "")).select("row_no")


@query("w08_by_status", "select rec_no from dimension_merged where document_type = 'EDITORIAL' and open_access = 'gold'")
def w08(s, d):
    return merged(s, d).where("document_type = 'EDITORIAL' and open_access = 'gold'").select("rec_no")


@query("w09_shared_token", f"""select distinct rec_no from (select rec_no, unnest(string_split(lower(journal_title), ' ')) as w from dimension_merged)
 where w in (select unnest(string_split(lower(title), ' ')) from {SJR})""")
def w09(s, d):
    words = lambda c: F.explode(F.split(F.lower(c), " ")).alias("w")
    mine = merged(s, d).select("rec_no", words("journal_title"))
    return mine.join(journals(s, d).select(words("title")).distinct(), "w", "left_semi").select("rec_no").distinct()


# -- joins -------------------------------------------------------------------------------------------------------------------


@query("j03_suffixed_join", f"select a.row_no, a.title as title_input, b.title as title_output from {SJR} a join {SJR} b on a.row_no = b.row_no")
def j03(s, d):
    a = journals(s, d).select("row_no", F.col("title").alias("title_input"))
    return a.join(journals(s, d).select("row_no", F.col("title").alias("title_output")), "row_no")


@query("j04_sampled_join", f"select r.row_no, r.title, (r.title = j.title) as same from (select * from {SJR} order by md5('7|' || cast(row_no as varchar)), row_no limit 200) r left join {SJR} j on j.row_no = r.row_no")
def j04(s, d):
    sample = orank.fixed_sample(journals(s, d), "row_no", 200, 7).select("row_no", "title")
    return sample.join(journals(s, d).select("row_no", F.col("title").alias("_t")), "row_no", "left").select("row_no", "title", (F.col("title") == F.col("_t")).alias("same"))


@query("j05_content_difference", f"select 'left' as side, count(*) as n from (select title from {SJR} except all select journal_title from dimension_merged)")
def j05(s, d):
    """Instead of a join by position: rows that the other side lacks, by content."""
    a, b = journals(s, d).select("title"), merged(s, d).select(F.col("journal_title").alias("title"))
    return op.multiset_difference(a, b).where("side = 'left'").groupBy("side").agg(F.count("*").alias("n"))


@query("j06_unique_candidates", f"""select m.rec_no, j.n from dimension_merged m left join (select title, count(*) as n from {SJR} group by title having count(*) = 1) j on j.title = m.journal_title""")
def j06(s, d):
    one = journals(s, d).groupBy(F.col("title").alias("journal_title")).agg(F.count("*").alias("n")).where("n = 1")
    return merged(s, d).join(one, "journal_title", "left").select("rec_no", "n")


@query("j11_country_indicator", f"""select c.country, c.n_journals, i.value from (select country, count(*) as n_journals from {SJR} where country is not null group by country) c left join {ref.ISO2_ROWS} on l.name = c.country
 left join (select k.code, round(avg(global_rank) + 2, 6) as value from institution_ranking join {ref.ISO2_ROWS.replace(' l(', ' k(')} on k.name = country group by k.code) i on i.code = l.code""")
def j11(s, d):
    """Figures per country, with the indicator of the same country code where there is one."""
    by = journals(s, d).where("country is not null").groupBy("country").agg(F.count("*").alias("n_journals"))
    values = read_indicator(s, indicator_file(s, d), "XX.MEAN.RANK", 2022).select(F.col("iso2c").alias("iso2"), F.round("value", 6).alias("value"))
    return with_country_code(by, "country").join(values, "iso2", "left").select("country", "n_journals", "value")


@query("j14_capped_totals", "select n_name, least(count(c_custkey), 50) as shown from nation left join customer on n_nationkey = c_nationkey group by n_name")
def j14(s, d):
    """The table behind a map: totals per country, capped."""
    by = table(s, d, "nation").join(table(s, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name").agg(F.count("c_custkey").alias("n"))
    return by.select("n_name", fm.capped(F.col("n"), 50)[0].alias("shown"))


@query("j15_overlay", f"""select a.row_no, coalesce(b.publisher, a.publisher) as publisher from {SJR} a left join (select row_no, 'checked' as publisher from {SJR} where country = 'Ghana') b on b.row_no = a.row_no""")
def j15(s, d):
    """Saved values laid over the records."""
    saved = journals(s, d).where("country = 'Ghana'").select("row_no", F.lit("checked").alias("_saved"))
    return journals(s, d).join(saved, "row_no", "left").select("row_no", F.coalesce("_saved", "publisher").alias("publisher"))


# -- aggregates, limits, sets -------------------------------------------------------------------------------------------------


@query("a05_first_year", f"select author_key, min(y) as first_year from (select a.author_key, {ref.YEAR} as y from {ref.FIRST_AUTHOR} a join dimension_merged m on m.rec_no = a.rec_no) where author_key is not null group by 1")
def a05(s, d):
    rows = merged(s, d).select(ref.first_author().alias("author_key"), ft.paper_year(F.col("year"), F.col("date")).alias("y")).where("author_key is not null")
    return rows.groupBy("author_key").agg(F.min("y").alias("first_year"))


@query("a19_reconciled", f"""select 'status' as figure, (select count(*) from {SJR}) as n_whole, (select count(*) from {SJR} where issn is null or upper(trim(issn)) in ('', 'NA')) +
 (select count(distinct row_no) from {ref.CHECKED} where {ref.STRICT} is not null) + (select count(*) from (select row_no from {ref.CHECKED} group by row_no having count(distinct {ref.STRICT}) = 0)) as n_parts
 union all select 'titles per file', (select count(distinct title) from {SJR}), (select count(*) from (select distinct source_filename, title from {SJR} where title is not null))
 union all select 'types', (select count(*) from dimension_merged), (select count(*) from dimension_merged where type is not null)""")
def a19(s, d):
    """Figures against the sums of their parts: statuses are complete, titles come in several files, some types are missing."""
    j, m = journals(s, d), merged(s, d)
    parts = {
        "status": (j.agg(F.count("*").alias("n")), ref.f28(s, d).groupBy("status").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"))),
        "titles per file": (j.agg(F.count_distinct("title").alias("n")), j.groupBy("source_filename").agg(F.count_distinct("title").alias("n")).agg(F.sum("n").alias("n"))),
        "types": (m.agg(F.count("*").alias("n")), m.where("type is not null").groupBy("type").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"))),
    }
    return op.reconciled(parts)


MEASURES = {"no title": "title is null", "no issn": "issn is null", "no publisher": "publisher is null", "comma as decimal mark": "sjr like '%,%'", "dash for issn": "issn = '-'"}


@query("a20_measures", " union all ".join(f"select '{k}' as measure, count(*) as n from {SJR} where {v}" for k, v in MEASURES.items()))
def a20(s, d):
    one = journals(s, d).agg(*[F.count_if(F.expr(v)).alias(k) for k, v in MEASURES.items()])
    return one.unpivot([], list(MEASURES), "measure", "n")


ORG = "list_filter(list_transform(regexp_split_to_array(research_org_names, '[;|]'), lambda x: trim(x)), lambda x: x <> '')"


@query("n09_ordered_distinct", f"""select rec_no, array_to_string(list_filter({ORG}, lambda x, i: list_position({ORG}, x) = i), '|') as kept from dimension_merged where research_org_names is not null""")
def n09(s, d):
    """Each name of a cell once, in the order in which the names come first."""
    names = F.filter(F.transform(F.split("research_org_names", "[;|]"), lambda x: F.btrim(x, F.lit(" \t\r\n\u00a0\ufeff"))), lambda x: x != "")
    return merged(s, d).where("research_org_names is not null").select("rec_no", F.array_join(F.array_distinct(names), "|").alias("kept"))


@query("l03_preview", f"select row_no, title from {SJR} order by row_no limit 10")
def l03(s, d):
    return journals(s, d).select("row_no", "title").orderBy("row_no").limit(10)


@query("l07_row_sample", "select o_orderkey from orders order by md5('2000|' || cast(o_orderkey as varchar)), o_orderkey limit 100")
def l07(s, d):
    return orank.fixed_sample(table(s, d, "orders"), "o_orderkey", 100, 2000).select("o_orderkey")


@query("u02_column_bind", f"select a.row_no, a.title, b.country from {SJR} a join {SJR} b on a.row_no = b.row_no")
def u02(s, d):
    """Columns put side by side by key, never by position."""
    return journals(s, d).select("row_no", "title").join(journals(s, d).select("row_no", "country"), "row_no")


@query("f26_language_id")
def f26(s, d):
    """The pluggable predictor with its offline default: shares of frequent words."""
    words = {
        "eng": "the of and to in that for with", "spa": "de la el los las en que por del", "por": "de da do os as em que uma dos", "fra": "de la le les des et en du dans",
        "deu": "die der und den das zu von mit", "ita": "di la il le che per del della gli", "ind": "yang dan di untuk pada dari dengan", "rus": "и в на с по не что для",
    }
    text = F.split(F.regexp_replace(F.lower(F.regexp_replace("title", r"\n", " ")), r"[^\p{L}\s]", " "), r"\s+")
    score = lambda ws: F.size(F.filter(text, lambda w: w.isin(*ws.split())))
    best = F.array_max(F.array(*[F.struct(score(ws).alias("n"), F.lit(k).alias("k")) for k, ws in words.items()]))
    return table(s, d, ref.SAMPLE).where("title is not null").select("id", F.when(best["n"] > 0, best["k"]).otherwise("und").alias("language_pred"))


@query("f25_extracted_people")
def f25(s, d):
    """The pluggable extractor with its rule-based default: names and affiliations of a field."""
    people = ft.struct_list(F.col("authors"), "first_name string, last_name string, raw_affiliation string")
    return merged(s, d).select(
        "rec_no", F.coalesce(F.array_join(F.transform(people, lambda p: F.concat_ws(", ", p["last_name"], p["first_name"])), "; "), F.lit("")).alias("authors_clean"),
        F.coalesce(F.size(F.array_distinct(F.filter(F.transform(people, lambda p: p["raw_affiliation"]), lambda a: a != ""))), F.lit(0)).alias("n_affiliations"),
    )


@query("f31_gated_comparison", f"""select rec_no, case when o is null or not o then 'not_compared' else state end as state from (select m.rec_no, exists (select 1 from {SJR} j where j.title = m.journal_title) as o,
 case when publisher is null or upper(trim(publisher)) in ('', 'NA') then 'not_observed' when publisher = 'Open Quay' then 'same' else 'different' end as state from dimension_merged m)""")
def f31(s, d):
    known = journals(s, d).select(F.col("title").alias("journal_title")).distinct().withColumn("_o", F.lit(True))
    state = fm.comparison_state(F.col("publisher"), F.lit("Open Quay"))
    return merged(s, d).join(known, "journal_title", "left").select("rec_no", F.when(F.col("_o"), state).otherwise("not_compared").alias("state"))


@query("x01_analysis_table")
def x01(s, d):
    return analysis_table(merged(s, d), "rec_no", journals(s, d), ref.best_rank(s, d), ref.first_author())
