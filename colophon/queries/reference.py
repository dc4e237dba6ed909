"""Queries of the general operators over whole tables, each with its SQL.

Names begin with the operator's mark in the blueprint (f01: scalar function 1).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.functions import identifiers as fi
from colophon.functions import measures as fm
from colophon.functions import names as fn
from colophon.functions import texts as ft
from colophon.functions.countries import with_country_code
from colophon.operators import documents as od
from colophon.operators import matching as om
from colophon.operators import profiling as op
from colophon.operators import ranking as orank
from colophon.session import join_split, table, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SJR = "scimagojr_communication_journal_1999_2024"
SAMPLE = "sample_records_language_title_abstract"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def merged(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "dimension_merged")


def journals(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, SJR)


# -- scalar functions ---------------------------------------------------------------------------------------------------

BARE = "regexp_replace(upper(trim(v)), '[^0-9X]', '', 'g')"
CHECKED = f"""(select *, {BARE} as b from (select row_no, unnest(regexp_split_to_array(issn, '[\\s,;|]+')) as v from {SJR}
 where issn is not null and upper(trim(issn)) not in ('', 'NA')))"""
CHECK_SUM = " + ".join(f"{w} * coalesce(try_cast(substr(b, {i}, 1) as int), 0)" for i, w in enumerate(fi.ISSN_WEIGHTS, 1))
STRICT = f"""case when regexp_full_match(b, '[0-9]{{7}}[0-9X]') and substr(b, 8, 1) =
 (case (11 - ({CHECK_SUM}) % 11) % 11 when 10 then 'X' else cast((11 - ({CHECK_SUM}) % 11) % 11 as varchar) end)
 then substr(b, 1, 4) || '-' || substr(b, 5, 4) end"""


@query("f01_issn_strict", f"select row_no, v as written, {STRICT} as issn from {CHECKED}")
def f01(s, d):
    parts = journals(s, d).where(~fi.is_missing(F.col("issn"))).select("row_no", F.explode(F.split("issn", r"[\s,;|]+")).alias("written"))
    return parts.select("row_no", "written", fi.issn_strict(F.col("written")).alias("issn"))


@query("f02_issns_of_row", f"select row_no, count(distinct {STRICT}) as n_valid from {CHECKED} group by row_no")
def f02(s, d):
    rows = journals(s, d).where(~fi.is_missing(F.col("issn")))
    return rows.select("row_no", F.size(fi.issns_strict(F.col("issn"))).cast("bigint").alias("n_valid"))


LOOSE_PARTS = f"""(select row_no, upper(trim(v)) as u, regexp_replace(upper(trim(v)), '[^\\p{{L}}\\p{{N}}]', '', 'g') as b from
 (select row_no, unnest(regexp_split_to_array(coalesce(issn, ''), '[;,|/\\s]+')) as v from {SJR}))"""


@query("f03_issn_loose", f"select row_no, b as issn from {LOOSE_PARTS} where u not in ('', '-', 'NA', 'NAN') and length(b) >= 7")
def f03(s, d):
    parts = journals(s, d).select("row_no", F.explode(F.split(F.coalesce("issn", F.lit("")), r"[;,|/\s]+")).alias("v"))
    return parts.select("row_no", fi.issn_loose(F.col("v")).alias("issn")).where("issn is not null")


@query("f04_issns_loose", f"""select row_no, string_agg(distinct b, '|' order by b) as issns from {LOOSE_PARTS}
 where u not in ('', '-', 'NA', 'NAN') and length(b) >= 7 group by row_no""")
def f04(s, d):
    rows = journals(s, d).select("row_no", fi.issn_set(fi.issns_loose(F.col("issn"))).alias("issns"))
    return rows.where("issns != ''")


@query("f05_issn_tokens", f"""select row_no, b as token from (select distinct row_no, regexp_replace(upper(v), '[^0-9X]', '', 'g') as b from
 (select row_no, unnest(regexp_extract_all(coalesce(issn, ''), '[0-9A-Za-z]+')) as v from {SJR})) where length(b) = 8""")
def f05(s, d):
    return journals(s, d).select("row_no", F.explode(fi.issn_tokens(F.col("issn"))).alias("token"))


@query("f06_row_issns", """select rec_no, string_agg(distinct b, '|' order by b) as issns from
 (select rec_no, regexp_replace(upper(trim(v)), '[^\\p{L}\\p{N}]', '', 'g') as b from (select rec_no, unnest(regexp_split_to_array(
 translate(coalesce(issn, '') || ';' || coalesce(isbn, ''), '[]''"', '    '), '[;,|/\\s]+')) as v from dimension_merged))
 where length(b) >= 7 and b not in ('NAN') group by rec_no""")
def f06(s, d):
    cells = F.translate(F.concat_ws(";", F.coalesce("issn", F.lit("")), F.coalesce("isbn", F.lit(""))), "[]'\"", "    ")
    return merged(s, d).select("rec_no", fi.issn_set(fi.issns_loose(cells)).alias("issns")).where("issns != ''")


@query("f07_title_key", """select rec_no, nullif(regexp_replace(lower(trim(title)), '[^\\p{L}\\p{N}]', '', 'g'), '') as title_key from dimension_merged""")
def f07(s, d):
    return merged(s, d).select("rec_no", ft.title_key(F.col("title")).alias("title_key"))


@query("f08_title_key_punct", """select rec_no, regexp_replace(lower(title), '[[:punct:]\\s]', '', 'g') as title_key from dimension_merged""")
def f08(s, d):
    return merged(s, d).select("rec_no", ft.title_key_punct(F.col("title")).alias("title_key"))


BODY_KEY = """trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '[-‐‑‒–—''’‘`"“”]', ' ', 'g'), '[^a-z0-9&\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"""


@query("f09_body_key", f"select inst_id, {BODY_KEY.format(c='institution')} as body_key from institution_ranking")
def f09(s, d):
    return table(s, d, "institution_ranking").select("inst_id", ft.body_key(F.col("institution")).alias("body_key"))


NAMES = """(select rec_no, trim(v) as v from (select rec_no, unnest(regexp_split_to_array(regexp_replace(research_org_names, '[\\[\\]"'']', ' ', 'g'),
 '[;,/|]|\\s{2,}')) as v from dimension_merged) where trim(v) <> '')"""


@query("f10_name_list", f"select rec_no, v as name from {NAMES}")
def f10(s, d):
    return merged(s, d).select("rec_no", F.explode(ft.name_list(F.col("research_org_names"))).alias("name"))


DOI = """nullif(regexp_replace(regexp_replace(lower(trim(doi)), '^(?:https?://(?:dx\\.)?doi\\.org/|doi:\\s*)', ''), '[\\s\u00a0]+', '', 'g'), '')"""


@query("f11_doi_normal", f"select rec_no, {DOI} as doi from dimension_merged")
def f11(s, d):
    return merged(s, d).select("rec_no", fi.doi_normal(F.col("doi")).alias("doi"))


@query("f12_host", """select h as host, count(*) as n from (select case when doi is null or upper(trim(doi)) in ('', 'NA') or
 regexp_extract(lower(doi), '^[a-z][a-z0-9+.-]*://([^/:?#]+)', 1) = '' then 'Missing URL'
 else regexp_extract(lower(doi), '^[a-z][a-z0-9+.-]*://([^/:?#]+)', 1) end as h from dimension_merged) group by 1""")
def f12(s, d):
    return merged(s, d).groupBy(fi.host(F.col("doi")).alias("host")).agg(F.count("*").alias("n"))


NUM = """case when regexp_full_match(trim({c}), '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?') then try_cast(trim({c}) as double) end"""
YEAR = f"coalesce(cast({NUM.format(c='year')} as int), try_cast(nullif(regexp_extract(date, '([0-9]{{4}})', 1), '') as int))"


@query("f13_paper_year", f"select rec_no, {YEAR} as paper_year from dimension_merged")
def f13(s, d):
    return merged(s, d).select("rec_no", ft.paper_year(F.col("year"), F.col("date")).alias("paper_year"))


@query("f14_struct_list", """select rec_no, coalesce(len(regexp_extract_all(researchers, '''id'':')), 0) as n_people from dimension_merged where researchers is not null""")
def f14(s, d):
    people = ft.struct_list(F.col("researchers"), "id string, first_name string, last_name string")
    return merged(s, d).where("researchers is not null").select("rec_no", F.size(people).cast("bigint").alias("n_people"))


FIRST_ID = """nullif(regexp_extract(coalesce(researchers, authors), '''(?:id|researcher_id|author_id)'':\\s*''([a-z]{2,}\\.[0-9]+)''', 1), '')"""


@query("f15_first_author", """select rec_no, nullif(regexp_extract(regexp_extract(researchers, '\\{[^{}]*\\}'), '''id'': ''([a-z]{2,}\\.[0-9]+)', 1), '') as author_key
 from dimension_merged""")
def f15(s, d):
    return merged(s, d).select("rec_no", first_author().alias("author_key"))


def first_author():
    """Id of the first of ``researchers``, else of ``authors``; nested ids count; a name alone is none."""
    fields = "id string, researcher_id string, author_id string, ids array<struct<dimensions_id: string, id: string>>"

    def of(c: str):
        one = F.get(ft.struct_list(F.col(c), fields), F.lit(0))
        inner = F.get(one["ids"], F.lit(0))
        any_id = F.coalesce(one["id"], one["researcher_id"], one["author_id"], inner["dimensions_id"], inner["id"])
        return F.when(any_id.rlike(r"^[a-z]{2,}\.[0-9]+"), F.regexp_extract(any_id, r"^([a-z]{2,}\.[0-9]+)", 1))

    return F.coalesce(of("researchers"), of("authors"))


TC = NUM.format(c="times_cited")


@query("f16_invisibility", f"select rec_no, case when {TC} = 0 then 1 when {TC} is not null then 0 end as invisibility from dimension_merged")
def f16(s, d):
    return merged(s, d).select("rec_no", fm.invisibility(F.col("times_cited")).alias("invisibility"))


@query("f17_invisible", f"select rec_no, case when {TC} is null or {TC} = 0 then 1 else 0 end as invisible from dimension_merged")
def f17(s, d):
    return merged(s, d).select("rec_no", fm.invisible(F.col("times_cited")).alias("invisible"))


@query("f18_prestige", """select inst_id, case when global_rank is null then 'Unknown' when global_rank <= 100 then 'Elite' when global_rank <= 500 then 'High'
 when global_rank <= 1000 then 'Medium' else 'Low' end as prestige from institution_ranking""")
def f18(s, d):
    return table(s, d, "institution_ranking").select("inst_id", fm.prestige(F.col("global_rank")).alias("prestige"))


TOK = """(select rec_no, regexp_replace(upper(v), '[^0-9X]', '', 'g') as b from (select rec_no, unnest(regexp_extract_all(
 regexp_replace(coalesce({c}, ''), '([0-9]{{4}})-([0-9]{{3}}[0-9Xx])', '\\1\\2', 'g'), '[0-9A-Za-z]+')) as v from {t}))"""


@query("f19_disciplinary", f"""select m.rec_no, exists (select 1 from {TOK.format(c='issn', t='dimension_merged')} a join
 (select distinct b from {TOK.format(c='issn', t=f"(select row_no as rec_no, issn from {SJR})")} where length(b) = 8) j on a.b = j.b where a.rec_no = m.rec_no and length(a.b) = 8)
 as disciplinary from dimension_merged m""")
def f19(s, d):
    tokens = lambda c: fi.issn_tokens(F.col(c), hyphen_aware=True)
    hit = om.covered_by_any(merged(s, d), "rec_no", [(tokens("issn"), journals(s, d), tokens("issn"))])
    return hit.withColumnRenamed("covered", "disciplinary")


PEOPLE = "array_to_string(regexp_extract_all(authors, '''last_name'': ''([^'']*)''', 1), '; ')"


def creators(s, d):
    """``rec_no``, ``creator``: family names of a record's authors, parted by semicolons."""
    last = F.regexp_extract_all("authors", F.lit(r"'last_name': '([^']*)'"), F.lit(1))
    return merged(s, d).select("rec_no", F.array_join(last, "; ").alias("creator"))


@query("f20_author_count", f"""select rec_no, len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(coalesce({PEOPLE}, ''),
 '(?i)(^|[^\\p{{L}}\\p{{N}}_])and($|[^\\p{{L}}\\p{{N}}_])', '\\1;\\2', 'g'), '(?i)(^|[^\\p{{L}}\\p{{N}}_])and($|[^\\p{{L}}\\p{{N}}_])', '\\1;\\2', 'g'), '[;&+/\\\\]'),
 lambda x: trim(x) <> '')) as n_authors from dimension_merged""")
def f20(s, d):
    return creators(s, d).select("rec_no", fn.author_count(F.col("creator")).cast("bigint").alias("n_authors"))


@query("f21_canonical_names")
def f21(s, d):
    full = F.regexp_replace("authors", r"'first_name': '([^']*)', 'last_name': '([^']*)'", "@$1 $2@")
    names = F.array_join(F.regexp_extract_all(full, F.lit("@([^@]*)@"), F.lit(1)), ", ")
    return merged(s, d).select("rec_no", fn.canonical_names(names).alias("creator_clean"))


@query("f22_rough_clean")
def f22(s, d):
    return table(s, d, SAMPLE).select("id", ft.rough_clean(F.col("title")).alias("title_clean"))


@query("f23_is_simple", f"""select rec_no, not regexp_matches(c, '(?i)\\b(universit|faculty|department|institute|hospital|school|center|college|email|@|www\\.|http|orcid|tel|phone|doi:)')
 and not regexp_matches(c, '(?i)[;&/\\\\]| and ') and len(regexp_extract_all(c, ',[ ]*\\p{{Lu}}')) <= 1 as simple
 from (select rec_no, {PEOPLE} as c from dimension_merged where authors is not null)""")
def f23(s, d):
    return creators(s, d).where("creator is not null").select("rec_no", fn.is_simple(F.col("creator")).alias("simple"))


@query("f24_last_first")
def f24(s, d):
    first = F.regexp_extract("authors", r"'first_name': '([^']*)'", 1)
    last = F.regexp_extract("authors", r"'last_name': '([^']*)'", 1)
    return merged(s, d).where("authors is not null").select("rec_no", fn.person_last_first(F.concat_ws(" ", first, last)).alias("person"))


@query("f28_identifier_status", f"""select m.row_no, case when issn is null or upper(trim(issn)) in ('', 'NA') then 'missing' when coalesce(n, 0) = 0 then 'invalid' else 'valid' end as status
 from {SJR} m left join (select row_no, count(distinct {STRICT}) as n from {CHECKED} group by row_no) k on k.row_no = m.row_no""")
def f28(s, d):
    return journals(s, d).select("row_no", fi.identifier_status(F.col("issn")).alias("status"))


@query("f30_comparison", """select rec_no, case when open_access is null or upper(trim(open_access)) in ('', 'NA') or publisher is null or upper(trim(publisher)) in ('', 'NA') then 'not_observed'
 when open_access = publisher then 'same' else 'different' end as state from dimension_merged""")
def f30(s, d):
    return merged(s, d).select("rec_no", fm.comparison_state(F.col("open_access"), F.col("publisher")).alias("state"))


@query("f32_issn_set", f"""select row_no, string_agg(distinct {STRICT}, '|' order by {STRICT}) as issn_set from {CHECKED} where {STRICT} is not null group by row_no""")
def f32(s, d):
    return journals(s, d).select("row_no", fi.issn_set(fi.issns_strict(F.col("issn"))).alias("issn_set")).where("issn_set != ''")


#: What the countries of the test tables are by ISO 3166, written out for the SQL side only.
ISO2 = {
    "Argentina": "AR", "Austria": "AT", "Bolivia, Plurinational State of": "BO", "Bosnia and Herzegovina": "BA", "Brazil": "BR", "Canada": "CA", "Chile": "CL",
    "Congo, Democratic Republic of": "CD", "Côte d'Ivoire": "CI", "France": "FR", "Germany": "DE", "Ghana": "GH", "Indonesia": "ID", "Italy": "IT",
    "Korea, Republic of": "KR", "Malaysia": "MY", "Mexico": "MX", "New Zealand": "NZ", "Portugal": "PT", "Spain": "ES", "Taiwan": "TW",
    "Tanzania, United Republic of": "TZ", "Trinidad and Tobago": "TT", "United Kingdom": "GB", "United States": "US",
}
ISO2_ROWS = "(values " + ", ".join("('{}', '{}')".format(k.replace("'", "''"), v) for k, v in ISO2.items()) + ") l(name, code)"


@query("f33_country_code", f"""select inst_id, country, l.code from institution_ranking left join {ISO2_ROWS} on l.name = country""")
def f33(s, d):
    return with_country_code(table(s, d, "institution_ranking").select("inst_id", "country"), "country", "code")


@query("f34_quoted_ids", """select rec_no, unnest(regexp_extract_all(researchers, '''id'':\\s*''([a-z]{2,}\\.[0-9]+)''', 1)) as person from dimension_merged""")
def f34(s, d):
    return merged(s, d).select("rec_no", F.explode(ft.quoted_ids(F.col("researchers"), r"[a-z]{2,}\.[0-9]+")).alias("person"))


CATEGORY = "(select rec_no, unnest(regexp_extract_all(category_for, '''name'': ''([^'']*)''', 1)) as c from dimension_merged)"


def categories(s, d):
    return merged(s, d).select("rec_no", "times_cited", F.explode(F.regexp_extract_all("category_for", F.lit(r"'name': '([^']*)'"), F.lit(1))).alias("c"))


@query("f35_category", f"select rec_no, try_cast(nullif(regexp_extract(c, '^([0-9]+)', 1), '') as int) as category_code, trim(regexp_replace(c, '^[0-9]+', '')) as category_name from {CATEGORY}")
def f35(s, d):
    return categories(s, d).select("rec_no", ft.category_code(F.col("c")).alias("category_code"), ft.category_name(F.col("c")).alias("category_name"))


CONCEPTS = "(select rec_no, unnest(string_split(translate(concepts, '[]''', ''), ', ')) as concept from dimension_merged)"


@query("f36_concepts", f"select concept, count(*) as n from {CONCEPTS} group by concept")
def f36(s, d):
    return merged(s, d).select(F.explode(ft.concept_list(F.col("concepts"))).alias("concept")).groupBy("concept").agg(F.count("*").alias("n"))


@query("f37_issn_state", f"""select case when issn is null then 'missing value' when trim(issn) = '' then 'blank string' when upper(trim(issn)) = 'NA' then 'literal NA'
 else 'present but invalid' end as state, count(*) as n from {SJR} group by 1""")
def f37(s, d):
    return journals(s, d).groupBy(fi.issn_state(F.col("issn")).alias("state")).agg(F.count("*").alias("n"))


@query("f38_complexity", f"""select rec_no, case when length(c) <= 50 and n <= 1 and not a then 'simple' when length(c) <= 200 and n <= 3 then 'medium' else 'complex' end as complexity
 from (select rec_no, {PEOPLE} as c, try_cast(authors_count as int) as n, contains(authors, 'staff') as a from dimension_merged where authors is not null)""")
def f38(s, d):
    rows = creators(s, d).join(merged(s, d).select("rec_no", F.expr("try_cast(authors_count as int)").alias("n"), F.contains("authors", F.lit("staff")).alias("a")), "rec_no")
    return rows.where("creator is not null").select("rec_no", fm.complexity(F.col("creator"), F.col("n"), F.col("a")).alias("complexity"))


def scored(s, d):
    """Records with the four scores of their authors as parsed from the literal."""
    people = ft.struct_list(F.col("authors"), "first_name string, last_name string, raw_affiliation string")
    # in steps, so that what is used more than once is parsed once
    rows = merged(s, d).where("authors is not null").select("rec_no", people.alias("p"), F.expr("coalesce(try_cast(authors_count as int), 1)").alias("n"))
    names = F.array_join(F.transform("p", lambda p: F.concat_ws(", ", p["last_name"], p["first_name"])), "; ")
    bodies = F.filter(F.transform("p", lambda p: p["raw_affiliation"]), lambda x: x != "")
    full = F.array_join(F.transform("p", lambda p: F.concat_ws(" ", p["first_name"], p["last_name"])), "; ")
    return fm.author_scores(rows.select("rec_no", "n", full.alias("creator"), names.alias("names"), bodies.alias("bodies")), ["rec_no"], "creator", "names", "bodies", "n")


@query("f39_author_scores")
def f39(s, d):
    """f39 to f42: identification, separation, classification and formatting."""
    return scored(s, d)


@query("f43_overall_score")
def f43(s, d):
    score, verdict = fm.overall({k: F.col(k) for k in fm.WEIGHTS})
    return scored(s, d).select("rec_no", score.alias("score"), verdict.alias("verdict"))


@query("f44_search_text", """select rec_no, case when length(t) > 40 then substr(t, 1, 40) || '...' else t end as search_text from
 (select rec_no, trim(regexp_replace(regexp_replace(title, '<[^>]*>', '', 'g'), '[\\s\u00a0]+', ' ', 'g')) as t from dimension_merged)""")
def f44(s, d):
    return merged(s, d).select("rec_no", ft.search_text(F.col("title"), 40).alias("search_text"))


WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '\\s+'), lambda x: x <> ''))"


@query("f45_external_confidence", f"""with w as (select rec_no, title, {DOI} as k, coalesce(len(regexp_extract_all(researchers, '''id'':\\s*''([a-z]{{2,}}\\.[0-9]+)''', 1)), 0) as n from dimension_merged),
 f as (select k, arg_min(title, rec_no) as found from w where k is not null and title is not null group by k),
 v as (select rec_no, n, {WORDS.format(c='title')} as p, {WORDS.format(c='found')} as q from w left join f using (k)),
 s as (select rec_no, case when len(p) > 0 and len(q) > 0 then len(list_intersect(p, q)) / (len(p) + len(q) - len(list_intersect(p, q))) else 0 end as a, 0.7 * least(1.0, n / 5.0) as b from v),
 t as (select rec_no, a > 0.3 as title_match, round(case when a > 0 and b > 0 then (a + b) / 2 else greatest(a, b) end, 6) as confidence from s)
 select *, case when confidence > 0.7 then 'high' when confidence > 0.4 then 'medium' else 'low' end as band from t""")
def f45(s, d):
    """The register's answer to a DOI is the title its first record has; a person's identifiers are those of the researchers."""
    ids = F.coalesce(F.size(ft.quoted_ids(F.col("researchers"), r"[a-z]{2,}\.[0-9]+")), F.lit(0))
    rows = merged(s, d).select("rec_no", "title", fi.doi_normal(F.col("doi")).alias("k"), F.greatest(ids, F.lit(0)).alias("n"))
    first = rows.where("k is not null and title is not null").groupBy("k").agg(F.min_by("title", "rec_no").alias("found"))
    scored = rows.join(first, "k", "left").select("rec_no", "n", fm.title_overlap(F.col("title"), F.col("found")).alias("a"))
    score, band = fm.external_confidence(F.col("a"), F.col("n"))
    return scored.select("rec_no", (F.col("a") > 0.3).alias("title_match"), score.alias("confidence"), band.alias("band"))


@query("f46_row_digest", "select line_id, sha256(raw_line) as digest from dimension_raw_lines")
def f46(s, d):
    return table(s, d, "dimension_raw_lines").select("line_id", F.sha2("raw_line", 256).alias("digest"))


@query("f47_type_title", "select distinct upper(substr(type, 1, 1)) || lower(substr(type, 2)) as type_title from dimension_merged")
def f47(s, d):
    return merged(s, d).select(F.initcap("type").alias("type_title")).distinct()


@query("f48_number", f"select rec_no, {TC} as n from dimension_merged")
def f48(s, d):
    return merged(s, d).select("rec_no", ft.number(F.col("times_cited")).alias("n"))


@query("f49_capped", f"""select rec_no, least(n, 5) as n, case when n >= 5 then '5+' else cast(n as varchar) end as label from
 (select rec_no, cast({TC} as bigint) as n from dimension_merged) where n is not null""")
def f49(s, d):
    rows = merged(s, d).select("rec_no", ft.number(F.col("times_cited")).cast("bigint").alias("n")).where("n is not null")
    value, label = fm.capped(F.col("n"), 5)
    return rows.select("rec_no", value.alias("n"), label.alias("label"))


@query("f50_json_row", """select inst_id, '{"institution":' || to_json(institution) || ',"global_rank":' || coalesce(cast(global_rank as varchar), 'null') || '}' as doc from institution_ranking""")
def f50(s, d):
    return table(s, d, "institution_ranking").select("inst_id", F.to_json(F.struct("institution", "global_rank"), {"ignoreNullFields": "false"}).alias("doc"))


# -- projections, filters -------------------------------------------------------------------------------------------------


@query("p_union_by_name", f"""select id, title, null as issn, 'records' as part from dimension_merged union all select null, title, issn, 'journals' from {SJR}""")
def union_by_name(s, d):
    a = merged(s, d).select("id", "title", F.lit("records").alias("part"))
    b = journals(s, d).select("title", "issn", F.lit("journals").alias("part"))
    return a.unionByName(b, allowMissingColumns=True)


@query("p05_json_path", """select rec_no, id as work_id, case when researchers is null then null else '[' || array_to_string(list_transform(regexp_extract_all(researchers, '''id'':\\s*''([a-z]{2,}\\.[0-9]+)''', 1), lambda x: '"' || x || '"'), ', ') || ']' end as people
 from dimension_merged""")
def p05(s, d):
    """Records as nested documents; a path through a list gives all its values."""
    ids = F.transform(ft.quoted_ids(F.col("researchers"), r"[a-z]{2,}\.[0-9]+"), lambda x: F.struct(F.struct(x.alias("id")).alias("person")))
    doc = F.to_json(F.struct(F.struct("id", ids.alias("people")).alias("work")))
    return merged(s, d).select("rec_no", doc.alias("doc")).select("rec_no", od.json_path(F.col("doc"), "work.id").alias("work_id"), od.json_path(F.col("doc"), "work.people.person.id").alias("people"))


@query("p06_abstract_of_index", "select rec_no, array_to_string(list_filter(string_split(regexp_replace(title, '\\s+', ' ', 'g'), ' '), lambda x: x <> ''), ' ') as abstract from dimension_merged where title is not null")
def p06(s, d):
    """An inverted index is built from each title and read back."""
    words = F.filter(F.split(F.regexp_replace("title", r"\s+", " "), " "), lambda x: x != "")
    long = merged(s, d).where("title is not null").select("rec_no", F.posexplode_outer(words).alias("at", "w"))
    spots = long.groupBy("rec_no", "w").agg(F.collect_list("at").alias("p")).groupBy("rec_no")
    index = spots.agg(F.map_from_entries(F.collect_list(F.when(F.col("w").isNotNull(), F.struct("w", "p")))).alias("index"))
    return od.with_abstract(index, "index").select("rec_no", "abstract")


@query("p08_numeric_type", f"select year, count({TC}) as n_numbers, sum({TC}) as total from dimension_merged group by year")
def p08(s, d):
    n = ft.number(F.col("times_cited"))
    return merged(s, d).groupBy("year").agg(F.count(n).alias("n_numbers"), F.sum(n).alias("total"))


INV = f"case when {TC} is null or {TC} = 0 then 1 else 0 end"


@query("p12_unpivot", f"""with b as (select type, sum({INV}) as i, count(*) as n from dimension_merged group by type)
 select type, 'Invisible' as seen, i as n from b union all select type, 'Visible', n - i from b""")
def p12(s, d):
    by = merged(s, d).groupBy("type").agg(F.sum(fm.invisible(F.col("times_cited"))).alias("Invisible"), F.count("*").alias("_n"))
    return by.withColumn("Visible", F.col("_n") - F.col("Invisible")).unpivot("type", ["Invisible", "Visible"], "seen", "n")


@query("p13_pivot", f"""select year, round(avg({INV}) filter (language = 'en'), 6) as english, round(avg({INV}) filter (language <> 'en'), 6) as other,
 round(avg({INV}) filter (language <> 'en') - avg({INV}) filter (language = 'en'), 6) as gap from dimension_merged where language is not null group by year""")
def p13(s, d):
    rows = merged(s, d).where("language is not null").select("year", F.when(F.col("language") == "en", "english").otherwise("other").alias("g"), fm.invisible(F.col("times_cited")).alias("i"))
    wide = rows.groupBy("year").pivot("g", ["english", "other"]).agg(F.avg("i"))
    return wide.select("year", F.round("english", 6).alias("english"), F.round("other", 6).alias("other"), F.round(F.col("other") - F.col("english"), 6).alias("gap"))


@query("p17_provenance", f"""select row_no, try_cast(list_last(regexp_extract_all(source_filename, '(?:19|20)[0-9]{{2}}')) as int) as file_year from {SJR}""")
def p17(s, d):
    return journals(s, d).select("row_no", ft.year_of_file(F.col("source_filename")).alias("file_year"))


@query("w01_type_filter", "select rec_no from dimension_merged where type in ('article', 'book', 'chapter')")
def w01(s, d):
    return merged(s, d).where(F.col("type").isin("article", "book", "chapter")).select("rec_no")


@query("w02_year_range", f"select rec_no from dimension_merged where {NUM.format(c='year')} between 2000 and 2022")
def w02(s, d):
    return merged(s, d).where(ft.number(F.col("year")).between(2000, 2022)).select("rec_no")


@query("w04_semi_join", f"select rec_no from dimension_merged where journal_title in (select title from {SJR})")
def w04(s, d):
    return merged(s, d).join(journals(s, d).select(F.col("title").alias("journal_title")), "journal_title", "left_semi").select("rec_no")


@query("w06_validity_split", f"""select case when sourceid is null or lower(trim(sourceid)) in ('', 'nan', 'none', 'null') then 'without' else 'with' end as part, count(*) as n from {SJR} group by 1""")
def w06(s, d):
    return journals(s, d).groupBy(F.when(sourceid().isNull(), "without").otherwise("with").alias("part")).agg(F.count("*").alias("n"))


@query("w07_targeted", f"""select rec_no from (select rec_no, {PEOPLE} as a, try_cast(authors_count as int) as n, contains(authors, 'staff') as b from dimension_merged where authors is not null)
 where contains(a, ';') or b or contains(a, '*') or trim(a) = '' or len(string_split(a, ';')) <> n""")
def w07(s, d):
    rows = creators(s, d).join(merged(s, d).select("rec_no", F.expr("try_cast(authors_count as int)").alias("n"), F.contains("authors", F.lit("staff")).alias("b")), "rec_no")
    a = F.col("creator")
    test = F.contains(a, F.lit(";")) | F.col("b") | F.contains(a, F.lit("*")) | (F.trim(a) == "") | (F.size(F.split(a, ";")) != F.col("n"))
    return rows.where(test).select("rec_no")


@query("w10_least_group", "select publisher, count(*) as n from dimension_merged group by publisher having count(*) >= 50")
def w10(s, d):
    return merged(s, d).groupBy("publisher").agg(F.count("*").alias("n")).where("n >= 50")


@query("w11_doi_like", "select rec_no from dimension_merged where regexp_matches(doi, '10\\.') and year >= '2020'")
def w11(s, d):
    return merged(s, d).where(F.col("doi").rlike(r"10\.") & (F.col("year") >= "2020")).select("rec_no")


# -- joins ----------------------------------------------------------------------------------------------------------------


@query("j01_star_join", """select o.o_orderkey, c.c_name, n.n_name from orders o left join customer c on o.o_custkey = c.c_custkey left join nation n on c.c_nationkey = n.n_nationkey""")
def j01(s, d):
    c, n = table(s, d, "customer"), table(s, d, "nation")
    o = table(s, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return o.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("o_orderkey", "c_name", "n_name")


RANK_KEY = BODY_KEY.format(c="institution")
NAME_RANK = f"""(select a.rec_no, min(r.global_rank) as best_rank from (select rec_no, {BODY_KEY.format(c='v')} as k from {NAMES}) a
 join (select {RANK_KEY} as k, min(global_rank) as global_rank from institution_ranking group by 1) r on a.k = r.k group by a.rec_no)"""


def best_rank(s, d):
    listed = table(s, d, "institution_ranking").select(ft.body_key(F.col("institution")).alias("k"), "global_rank")
    listed = orank.best_per_key(listed, "k", F.col("global_rank"), F.col("global_rank"), "global_rank")
    names = merged(s, d).select("rec_no", F.explode(ft.name_list(F.col("research_org_names"))).alias("v"))
    hits = names.select("rec_no", ft.body_key(F.col("v")).alias("k")).join(listed, "k")
    return hits.groupBy("rec_no").agg(F.min("global_rank").alias("best_rank"))


@query("j02_wide_variables", f"""select m.rec_no, {INV} as invisible, {YEAR} as paper_year, r.best_rank from dimension_merged m left join {NAME_RANK} r on r.rec_no = m.rec_no""")
def j02(s, d):
    m = merged(s, d).select("rec_no", fm.invisible(F.col("times_cited")).alias("invisible"), ft.paper_year(F.col("year"), F.col("date")).alias("paper_year"))
    return m.join(best_rank(s, d), "rec_no", "left")


STRICT_ROWS = f"(select distinct row_no, {STRICT} as issn from {CHECKED} where {STRICT} is not null)"


ANY_ISSN = """(select {k}, v, regexp_replace(upper(trim(v)), '[^0-9X]', '', 'g') as b from (select {k}, unnest(regexp_split_to_array(translate(regexp_replace(issn, '[–‐‑]', '-', 'g'),
 '[]"''/', '     '), '[\\s,;|]+')) as v from {t} where issn is not null and upper(trim(issn)) not in ('', 'NA')))"""
SID_OF = "regexp_replace(regexp_replace(trim(sourceid), '^0+([0-9])', '\\1'), '\\.0$', '')"
J07 = f"""with m as (select distinct rec_no, {STRICT} as i from {ANY_ISSN.format(k='rec_no', t='dimension_merged')} where {STRICT} is not null),
 j as (select distinct sid, {STRICT} as i from {ANY_ISSN.format(k='sid', t=f"(select {SID_OF} as sid, issn from {SJR} where sourceid is not null and lower(trim(sourceid)) not in ('', 'nan', 'none', 'null'))")} where {STRICT} is not null),
 h as (select rec_no, string_agg(distinct i, '|' order by i) as k, string_agg(distinct sid, '|' order by sid) as c, count(distinct sid) as n from m join j using (i) group by rec_no),
 a as (select distinct rec_no from m) select r.rec_no, case when a.rec_no is null then 'not_attempted' when coalesce(n, 0) = 0 then 'unmatched' when n = 1 then 'unique' else 'ambiguous' end as status,
 coalesce(k, '') as matched_keys, coalesce(c, '') as candidate_ids from dimension_merged r left join h using (rec_no) left join a using (rec_no)"""


@query("j07_shared_issn", J07)
def j07(s, d):
    """Records to journals by any shared valid ISSN: status, shared ISSNs, candidates."""
    ids = journals(s, d).where(sourceid().isNotNull()).select(sourceid().alias("sid"), "issn")
    return om.shared_key_match(merged(s, d), "rec_no", clean_issns("issn"), ids, "sid", clean_issns("issn"))


def clean_issns(c: str):
    """Valid ISSNs of a cell in any notation."""
    return fi.issns_strict(F.regexp_replace(F.regexp_replace(F.col(c), "[–‐‑]", "-"), r"""[\[\]"'/]""", " "))


def sourceid():
    bare = F.trim(F.col("sourceid"))
    return F.when(~F.lower(bare).isin("", "nan", "none", "null"), F.regexp_replace(bare, r"^0+(?=\d)|\.0$", ""))


LOOSE_M = """(select rec_no, regexp_replace(upper(trim(v)), '[^\\p{L}\\p{N}]', '', 'g') as b, upper(trim(v)) as u from
 (select rec_no, unnest(regexp_split_to_array(coalesce(issn, ''), '[;,|/\\s]+')) as v from dimension_merged))"""
TKEY = "nullif(regexp_replace(lower(trim({c})), '[^\\p{{L}}\\p{{N}}]', '', 'g'), '')"


@query("j08_coverage", f"""with i as (select distinct b from {LOOSE_M} where u not in ('', '-', 'NA', 'NAN') and length(b) >= 7),
 t as (select distinct {TKEY.format(c='journal_title')} as k from dimension_merged),
 h as (select distinct p.row_no from {LOOSE_PARTS} p join i on i.b = p.b where p.u not in ('', '-', 'NA', 'NAN') and length(p.b) >= 7)
 select j.row_no, (h.row_no is not null or t.k is not null) as covered from {SJR} j left join h on h.row_no = j.row_no left join t on t.k = {TKEY.format(c='j.title')}""")
def j08(s, d):
    return coverage(s, d)


def coverage(s, d):
    works, js = merged(s, d), journals(s, d)
    one = lambda c: F.array(ft.title_key(F.col(c)))
    loose = fi.issns_loose(F.col("issn"))
    return om.covered_by_any(js, "row_no", [(loose, works, loose), (one("title"), works, one("journal_title"))])


@query("j09_issn_years", f"""select count(distinct m.rec_no) as n_works from {LOOSE_M} p join dimension_merged m on m.rec_no = p.rec_no join (select distinct b from {LOOSE_PARTS}) j on j.b = p.b
 where length(p.b) >= 7 and p.u not in ('', '-', 'NA', 'NAN') and {NUM.format(c='m.year')} between 2000 and 2022""")
def j09(s, d):
    works = merged(s, d).where(ft.number(F.col("year")).between(2000, 2022))
    hit = om.covered_by_any(works, "rec_no", [(fi.issns_loose(F.col("issn")), journals(s, d), fi.issns_loose(F.col("issn")))])
    return hit.agg(F.count_if("covered").alias("n_works"))


@query("j10_near_match")
def j10(s, d):
    names = merged(s, d).select("rec_no", F.explode(ft.name_list(F.col("research_org_names"))).alias("v")).select("rec_no", ft.body_key(F.col("v")).alias("name"))
    listed = table(s, d, "institution_ranking").select(ft.body_key(F.col("institution")).alias("entry"))
    return om.near_match(names, "rec_no", "name", listed, "entry")


@query("j12_full_join", f"""with a as (select c, count(*) as n from {CATEGORY} x join dimension_merged m using (rec_no) where {INV} = 1 group by c),
 b as (select c, count(*) as n from {CATEGORY} x join dimension_merged m using (rec_no) where {INV} = 0 group by c)
 select coalesce(a.c, b.c) as category, a.n as n_invisible, b.n as n_visible from a full join b on a.c = b.c""")
def j12(s, d):
    c = categories(s, d).withColumn("i", fm.invisible(F.col("times_cited")))
    side = lambda v, name: c.where(F.col("i") == v).groupBy(F.col("c").alias("category")).agg(F.count("*").alias(name))
    return side(1, "n_invisible").join(side(0, "n_visible"), "category", "full")


@query("j13_anti_join", f"""select distinct concept from {CONCEPTS} where concept not in (select coalesce(v, '') from (select unnest(string_split(translate(concepts, '[]''"', ''), ', ')) as v
 from dimension_merged where year = '2020'))""")
def j13(s, d):
    every = merged(s, d).select(F.explode(ft.concept_list(F.col("concepts"))).alias("concept")).distinct()
    late = merged(s, d).where("year = '2020'").select(F.explode(F.split(F.translate("concepts", "[]'\"", ""), ", ")).alias("concept"))
    return every.join(late, "concept", "left_anti")


@query("j16_ordered_lookup", "select r.inst_id, l.ord from institution_ranking r join (values (10022, 1), (10001, 2), (10050, 3)) l(inst_id, ord) on l.inst_id = r.inst_id order by l.ord")
def j16(s, d):
    wanted = s.createDataFrame([(10022, 1), (10001, 2), (10050, 3)], "inst_id bigint, ord int")
    return table(s, d, "institution_ranking").join(F.broadcast(wanted), "inst_id").orderBy("ord").select("inst_id", "ord")


# -- aggregates -----------------------------------------------------------------------------------------------------------


@query("a01_value_counts", "select open_access, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from dimension_merged group by open_access")
def a01(s, d):
    by = merged(s, d).groupBy("open_access").agg(F.count("*").alias("n"))
    return op.share_of_all(by, "n").withColumn("share", F.round("share", 6))


@query("a02_type_year", "select type, year, count(*) as n from dimension_merged group by type, year")
def a02(s, d):
    return merged(s, d).groupBy("type", "year").agg(F.count("*").alias("n"))


@query("a03_mean_flag", f"select journal_title, round(avg({INV}), 6) as share_invisible from dimension_merged group by journal_title")
def a03(s, d):
    return merged(s, d).groupBy("journal_title").agg(F.round(F.avg(fm.invisible(F.col("times_cited"))), 6).alias("share_invisible"))


@query("a04_conditional_sums", f"select year, count(*) as n_all, sum({INV}) as n_invisible, count(*) - sum({INV}) as n_visible from dimension_merged group by year")
def a04(s, d):
    inv = F.sum(fm.invisible(F.col("times_cited")))
    return merged(s, d).groupBy("year").agg(F.count("*").alias("n_all"), inv.alias("n_invisible"), (F.count("*") - inv).alias("n_visible"))


PROFILED = ("id", "doi", "title", "times_cited", "isbn", "language")


@query("a06_column_profile", " union all ".join(
    f"""select '{c}' as column_name, count(*) as n_rows, sum(case when {c} is null or trim({c}) = '' then 1 else 0 end) as n_missing, count(distinct {c}) as n_distinct,
 round(sum(case when {c} is null or trim({c}) = '' then 1 else 0 end) / count(*), 4) as missing_ratio from dimension_merged""" for c in PROFILED))
def a06(s, d):
    return op.column_profile(merged(s, d), PROFILED)


@query("a07_duplicate_dois", f"select doi_key, count(*) as n from (select {DOI} as doi_key from dimension_merged) where doi_key is not null group by 1 having count(*) > 1")
def a07(s, d):
    return op.duplicate_groups(merged(s, d), fi.doi_normal(F.col("doi")), "doi_key")


@query("a08_rows_in_duplicates", f"select coalesce(sum(n), 0) as n_rows from (select count(*) as n from dimension_merged where {DOI} is not null group by {DOI} having count(*) > 1)")
def a08(s, d):
    return op.duplicate_groups(merged(s, d), fi.doi_normal(F.col("doi"))).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))


@query("a09_exact_duplicates", "select count(*) - count(distinct (id, doi, title, times_cited, year)) as n_copies from dimension_merged")
def a09(s, d):
    rows = merged(s, d).select("id", "doi", "title", "times_cited", "year")
    return rows.groupBy(*rows.columns).count().agg((F.sum("count") - F.count("*")).alias("n_copies"))


@query("a10_years", f"""select min(y) as first_year, max(y) as last_year, count(*) - count(y) as n_without, sum(case when y < 1900 or y > 2030 then 1 else 0 end) as n_odd
 from (select cast({NUM.format(c='year')} as int) as y from dimension_merged)""")
def a10(s, d):
    y = merged(s, d).select(ft.number(F.col("year")).cast("int").alias("y"))
    return y.agg(F.min("y").alias("first_year"), F.max("y").alias("last_year"), F.count_if(F.col("y").isNull()).alias("n_without"), F.count_if((F.col("y") < 1900) | (F.col("y") > 2030)).alias("n_odd"))


@query("a11_quantiles", f"select round(quantile_cont(n, 0.5), 4) as q50, round(quantile_cont(n, 0.9), 4) as q90, round(quantile_cont(n, 0.99), 4) as q99 from (select {TC} as n from dimension_merged)")
def a11(s, d):
    q = F.expr("percentile(n, array(0.5D, 0.9D, 0.99D))")
    return merged(s, d).select(ft.number(F.col("times_cited")).alias("n")).agg(q.alias("q")).select(*[F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(("q50", "q90", "q99"))])


TOKENS = ", ".join("('" + t.replace("'", "''") + "')" for t in op.NULL_TOKENS)


@query("a12_null_tokens", " union all ".join(
    f"select '{c}' as column_name, t.token, count(m.{c}) as n from (values {TOKENS}) t(token) left join (select coalesce({c}, '') as {c} from dimension_merged) m on m.{c} = t.token group by t.token" for c in PROFILED))
def a12(s, d):
    return op.token_counts(merged(s, d), PROFILED)


PARITY = "(select count(*) from {t} where coalesce({c}, '') = t.token)"
DISTINCT_ROWS = f"(select distinct {', '.join(PROFILED)} from dimension_merged)"


@query("a12_token_parity", "select *, n_merged < n_raw as lost, n_merged > n_raw as added from (" + " union all ".join(
    f"select '{c}' as column_name, t.token, {PARITY.format(t='dimension_merged', c=c)} as n_raw, {PARITY.format(t=DISTINCT_ROWS, c=c)} as n_merged from (values {TOKENS}) t(token)" for c in PROFILED) + ")")
def a12b(s, d):
    m = merged(s, d).select(*PROFILED)
    return op.token_parity({"raw": m, "merged": m.dropDuplicates()}, PROFILED)


@query("a13_rows_per_file", "select source_file, count(*) as n from dimension_merged group by 1 union all select 'all', count(*) from dimension_merged")
def a13(s, d):
    return merged(s, d).rollup("source_file").agg(F.count("*").alias("n"), F.grouping("source_file").alias("_g")).select(
        F.when(F.col("_g") == 1, "all").otherwise(F.col("source_file")).alias("source_file"), "n"
    )


@query("a14_coverage_summary", f"select count(*) as n_total, count(*) filter (covered) as n_covered, round(avg(covered::int), 6) as rate from ({SQL['j08_coverage']})")
def a14(s, d):
    c = coverage(s, d)
    return c.agg(F.count("*").alias("n_total"), F.count_if("covered").alias("n_covered"), F.round(F.avg(F.col("covered").cast("double")), 6).alias("rate"))


@query("a15_works_by_issn_year", f"select b as issn, m.year, count(distinct m.rec_no) as n from {LOOSE_M} p join dimension_merged m using (rec_no) where length(b) >= 7 and u not in ('NAN') group by 1, 2")
def a15(s, d):
    rows = merged(s, d).select("rec_no", "year", F.explode(fi.issns_loose(F.col("issn"))).alias("issn")).dropDuplicates(["rec_no", "issn"])
    return rows.groupBy("issn", "year").agg(F.count("*").alias("n"))


STATUSES = ("missing", "invalid", "valid")


@query("a16_zero_filled", f"""select t.status, count(q.row_no) as n, round(100.0 * count(q.row_no) / (select count(*) from {SJR}), 3) as percent from (values ('missing'), ('invalid'), ('valid')) t(status)
 left join ({SQL['f28_identifier_status']}) q on q.status = t.status group by t.status""")
def a16(s, d):
    counts = f28(s, d).groupBy("status").agg(F.count("*").alias("n"))
    full = op.share_of_all(op.with_all(counts, {"status": STATUSES}), "n", "percent")
    return full.withColumn("percent", F.round(100 * F.col("percent"), 3))


TYPES, ACCESS = ("article", "book", "chapter", "monograph"), ("gold", "green", "bronze", "closed", "hybrid")


@query("a17_crosstab", f"""select t.type, a.open_access, count(m.rec_no) as n from (values {', '.join(f"('{x}')" for x in TYPES)}) t(type) cross join
 (values {', '.join(f"('{x}')" for x in ACCESS)}) a(open_access) left join dimension_merged m on m.type = t.type and m.open_access = a.open_access group by 1, 2""")
def a17(s, d):
    counts = merged(s, d).groupBy("type", "open_access").agg(F.count("*").alias("n"))
    return op.with_all(counts, {"type": TYPES, "open_access": ACCESS})


@query("a18_conditional_table", "select 'no doi' as measure, sum(case when doi is null then 1 else 0 end) as n from dimension_merged union all select 'no issn', sum(case when issn is null then 1 else 0 end) from dimension_merged union all select 'no names', sum(case when research_org_names is null then 1 else 0 end) from dimension_merged")
def a18(s, d):
    none = lambda c: F.count_if(F.col(c).isNull())
    one = merged(s, d).agg(none("doi").alias("no doi"), none("issn").alias("no issn"), none("research_org_names").alias("no names"))
    return one.unpivot([], ["no doi", "no issn", "no names"], "measure", "n")


BAND_CASE = "case when n is null then 'missing' when n < 10 then 'under 10' when n < 25 then '10-24' when n < 50 then '25-49' when n < 100 then '50-99' when n < 1000 then '100-999' else '1000 or more' end"


@query("a21_bands", f"""select b.band, count(q.band) as n from (values {', '.join(f"('{x}')" for x in fm.BANDS)}) b(band) left join
 (select {BAND_CASE} as band from (select {TC} as n from dimension_merged)) q on q.band = b.band group by b.band""")
def a21(s, d):
    by = merged(s, d).groupBy(fm.record_band(ft.number(F.col("times_cited"))).alias("band")).agg(F.count("*").alias("n"))
    return op.with_all(by, {"band": fm.BANDS})


@query("a22_share_of_all", "select publisher, round(count(*) / sum(count(*)) over (), 6) as share from dimension_merged group by publisher")
def a22(s, d):
    by = merged(s, d).groupBy("publisher").agg(F.count("*").alias("n"))
    return op.share_of_all(by, "n").select("publisher", F.round("share", 6).alias("share"))


@query("a23_completion", f"select type, count(*) as n, round(sum(case when doi is not null then 1 else 0 end) / count(*), 6) as completion from dimension_merged group by rollup (type)")
def a23(s, d):
    return merged(s, d).rollup("type").agg(F.count("*").alias("n"), F.round(F.count("doi") / F.count("*"), 6).alias("completion"))


@query("a24_unique_people", "select count(distinct v) as n_people from (select unnest(regexp_extract_all(researchers, '''id'':\\s*''([a-z]{2,}\\.[0-9]+)''', 1)) as v from dimension_merged)")
def a24(s, d):
    return f34(s, d).agg(F.count_distinct("person").alias("n_people"))


@query("a25_first_example", "select type, arg_min(title, rec_no) as example from dimension_merged where title is not null group by type")
def a25(s, d):
    return merged(s, d).where("title is not null").groupBy("type").agg(F.min_by("title", "rec_no").alias("example"))


@query("a26_issn_set", f"select distinct b as issn from {LOOSE_PARTS} where u not in ('', '-', 'NA', 'NAN') and length(b) >= 7")
def a26(s, d):
    return journals(s, d).select(F.explode(fi.issns_loose(F.col("issn"))).alias("issn")).distinct()


@query("a27_line", f"select round(regr_slope(n, y), 8) as slope, round(regr_intercept(n, y), 4) as intercept, round(regr_r2(n, y), 8) as r2 from (select {TC} as n, {NUM.format(c='year')} as y from dimension_merged)")
def a27(s, d):
    rows = merged(s, d).select(ft.number(F.col("times_cited")).alias("n"), ft.number(F.col("year")).alias("y")).where("n is not null and y is not null")
    return rows.agg(F.round(F.regr_slope("n", "y"), 8).alias("slope"), F.round(F.regr_intercept("n", "y"), 4).alias("intercept"), F.round(F.regr_r2("n", "y"), 8).alias("r2"))


@query("a28_loess")
def a28(s, d):
    by = merged(s, d).groupBy("type", ft.number(F.col("year")).alias("y")).agg(F.avg(fm.invisible(F.col("times_cited"))).alias("share"))
    return op.loess(by.where("y is not null"), "type", "y", "share", 1.0).withColumn("smooth", F.round("smooth", 6))


@query("a29_wilson", f"""select type, n, k, round((k / n + 3.841458820694124 / (2 * n) - 1.959963984540054 * sqrt(k / n * (1 - k / n) / n + 3.841458820694124 / (4.0 * n * n))) / (1 + 3.841458820694124 / n), 6) as low,
 round((k / n + 3.841458820694124 / (2 * n) + 1.959963984540054 * sqrt(k / n * (1 - k / n) / n + 3.841458820694124 / (4.0 * n * n))) / (1 + 3.841458820694124 / n), 6) as high
 from (select type, count(*) as n, sum({INV}) as k from dimension_merged group by type)""")
def a29(s, d):
    by = merged(s, d).groupBy("type").agg(F.count("*").alias("n"), F.sum(fm.invisible(F.col("times_cited"))).alias("k"))
    low, high = fm.wilson(F.col("k"), F.col("n"))
    return by.select("type", "n", "k", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("a30_source_years", f"select source_file, count(*) as n, min(y) as first, max(y) as last, round(avg(y), 4) as mean from (select source_file, {NUM.format(c='year')} as y from dimension_merged) group by 1")
def a30(s, d):
    y = ft.number(F.col("year"))
    return merged(s, d).groupBy("source_file").agg(F.count("*").alias("n"), F.min(y).alias("first"), F.max(y).alias("last"), F.round(F.avg(y), 4).alias("mean"))


# -- ranking, sampling, sets ----------------------------------------------------------------------------------------------

SID = "regexp_replace(trim(sourceid), '^0+([0-9])|\\.0$', '\\1')"
VALID_SID = "sourceid is not null and lower(trim(sourceid)) not in ('', 'nan', 'none', 'null')"


def latest(s, d):
    rows = journals(s, d).withColumn("sid", F.trim("sourceid")).where(sourceid().isNotNull())
    return orank.keep_latest(rows, "sid", [F.desc_nulls_last("year"), F.desc_nulls_last("source_mtime"), F.asc("row_no")])


RANKED = f"(select *, trim(sourceid) as sid, row_number() over (partition by trim(sourceid) order by year desc nulls last, source_mtime desc nulls last, row_no) as r from {SJR} where {VALID_SID})"


@query("n01_latest_per_key", f"select sid, row_no from {RANKED} where r = 1")
def n01(s, d):
    return latest(s, d)[0].select("sid", "row_no")


DIFFERENT = "trim(cast(o.{c} as varchar)) is distinct from trim(cast(k.{c} as varchar))"
COMPARED = ("country", "issn", "publisher", "rank", "sjr", "title", "type")


@query("n02_changed_columns", f"""select row_no, sid, coalesce(nullif(array_to_string(list_filter([{', '.join(f"case when {DIFFERENT.format(c=c)} then '{c}' end" for c in COMPARED)}], lambda x: x is not null), ','), ''), 'none')
 as changed from (select o.row_no, o.sid, {', '.join(f'o.{c} as {c}' for c in COMPARED)} from {RANKED} o where r > 1) o join (select sid as ksid, {', '.join(COMPARED)} from {RANKED} where r = 1) k on k.ksid = o.sid""")
def n02(s, d):
    kept, others = latest(s, d)
    return orank.changed_columns(others, kept, "sid", "row_no", COMPARED)


@query("n03_best_rank", f"select {RANK_KEY} as k, min(global_rank) as global_rank from institution_ranking group by 1")
def n03(s, d):
    listed = table(s, d, "institution_ranking").select(ft.body_key(F.col("institution")).alias("k"), "global_rank")
    return orank.best_per_key(listed, "k", F.col("global_rank"), F.col("global_rank"), "global_rank")


@query("n04_best_candidate", f"select rec_no, best_rank from {NAME_RANK}")
def n04(s, d):
    return best_rank(s, d)


@query("n05_first_of_list", "select rec_no, trim(string_split(translate(concepts, '[]''', ''), ', ')[1]) as first_concept from dimension_merged where concepts is not null")
def n05(s, d):
    return merged(s, d).where("concepts is not null").select("rec_no", F.trim(F.get(ft.concept_list(F.col("concepts")), F.lit(0))).alias("first_concept"))


@query("n06_top_share", f"""select concept, n from (select concept, n, row_number() over (order by n desc, concept) as r, count(*) over () as c from
 (select concept, count(*) as n from {CONCEPTS} group by concept)) where r <= floor(0.2 * c)""")
def n06(s, d):
    """As many of the most frequent as a fifth of all; sorted by ranges or as a top-k, never in one window."""
    by = written(f36(s, d))
    return by.orderBy(F.desc("n"), "concept").limit(by.count() // 5)


FIRST_AUTHOR = f"({SQL['f15_first_author']})"


@query("n07_experience", f"""select rec_no, y - min(y) over (partition by author_key) as experience from (select a.rec_no, a.author_key, {YEAR} as y from {FIRST_AUTHOR} a join dimension_merged m on m.rec_no = a.rec_no)
 where author_key is not null and y is not null""")
def n07(s, d):
    """The first year per author by partial aggregation, joined back: no author's papers are sorted in one task. The literals are parsed once."""
    rows = merged(s, d).select("rec_no", first_author().alias("author_key"), ft.paper_year(F.col("year"), F.col("date")).alias("y"))
    rows = written(rows).where("author_key is not null and y is not null")
    first = rows.groupBy("author_key").agg(F.min("y").alias("first"), F.count("*").alias("n"))
    return join_split(rows, first, ["author_key"], "n", rows.count()).select("rec_no", (F.col("y") - F.col("first")).alias("experience"))


@query("n08_distinct_by_key", f"select {TKEY.format(c='title')} as k, min(row_no) as row_no from {SJR} group by 1")
def n08(s, d):
    return journals(s, d).groupBy(ft.title_key(F.col("title")).alias("k")).agg(F.min("row_no").alias("row_no"))


@query("n10_distinct_pairs", "select distinct id, year from dimension_merged")
def n10(s, d):
    return merged(s, d).select("id", "year").dropDuplicates()


@query("l01_multi_sort", f"select row_no, year, title from {SJR} order by year desc, title, row_no")
def l01(s, d):
    return journals(s, d).select("row_no", "year", "title").orderBy(F.desc("year"), "title", "row_no")


@query("l02_top_keys", "select journal_title, count(*) as n from dimension_merged where journal_title is not null group by 1 order by n desc, journal_title limit 10")
def l02(s, d):
    by = merged(s, d).where("journal_title is not null").groupBy("journal_title").agg(F.count("*").alias("n"))
    return by.orderBy(F.desc("n"), "journal_title").limit(10)


@query("l04_stratified_sample", """select rec_no from (select rec_no, row_number() over (partition by authors_count order by md5('0|' || cast(rec_no as varchar))) as r from dimension_merged
 where try_cast(authors_count as int) > 0) where r <= 10""")
def l04(s, d):
    rows = merged(s, d).where(F.expr("try_cast(authors_count as int) > 0"))
    return orank.stratified_sample(rows, "authors_count", "rec_no", 10).select("rec_no")


@query("l05_quota_sample", """select rec_no, type from (select rec_no, type, row_number() over (partition by type order by md5('0|' || cast(rec_no as varchar))) as r from dimension_merged)
 where r <= case type when 'article' then 10 when 'book' then 20 when 'chapter' then 30 else 0 end""")
def l05(s, d):
    return orank.quota_sample(merged(s, d), "type", "rec_no", {"article": 10, "book": 20, "chapter": 30}).select("rec_no", "type")


@query("l06_fixed_sample", "select rec_no from dimension_merged order by md5('20260815|' || cast(rec_no as varchar)), rec_no limit 12")
def l06(s, d):
    return orank.fixed_sample(merged(s, d), "rec_no", 12, 20260815).select("rec_no")


@query("u03_intersect_keys", f"select row_no, len(list_intersect(a, b)) as n from (select row_no, regexp_extract_all(coalesce(issn, ''), '[0-9]') as a, regexp_extract_all(coalesce(sourceid, ''), '[0-9]') as b from {SJR})")
def u03(s, d):
    digits = lambda c: F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit("([0-9])"), F.lit(1))
    return journals(s, d).select("row_no", F.size(F.array_intersect(digits("issn"), digits("sourceid"))).cast("bigint").alias("n"))


@query("u04_multiset_equality", f"""select side, title, issn, count(*) as n from (select 'left' as side, * from (select title, issn from {SJR} except all select title, replace(issn, '-', '') from {SJR})
 union all select 'right', * from (select title, replace(issn, '-', '') as issn from {SJR} except all select title, issn from {SJR})) group by all""")
def u04(s, d):
    """Rows as they are against the same with ISSNs written without hyphens: equal but for those that hold one."""
    a = journals(s, d).select("title", "issn")
    b = a.withColumn("issn", F.replace("issn", F.lit("-"), F.lit("")))
    return op.multiset_difference(a, b).groupBy("side", "title", "issn").agg(F.count("*").alias("n"))


@query("u05_distinct_rows", "select count(*) as n from (select distinct id, title, year from dimension_merged)")
def u05(s, d):
    return merged(s, d).select("id", "title", "year").distinct().agg(F.count("*").alias("n"))


@query("p07_wide_expansion")
def p07(s, d):
    """Fields of the one matching journal, or all of them as JSON."""
    kept = latest(s, d)[0].select("sid", "title", "country")
    matched = j07(s, d).select("rec_no", F.filter(F.split("candidate_ids", r"\|"), lambda v: v != "").alias("ids"))
    return om.expand_candidates(matched, "rec_no", F.col("ids"), kept, "sid", ["title", "country"])


@query("f27_match_status", f"select status, count(*) as n from ({J07}) group by status")
def f27(s, d):
    return j07(s, d).groupBy("status").agg(F.count("*").alias("n"))


@query("f29_identity_outcome")
def f29(s, d):
    kept = latest(s, d)[0].select("sid", F.col("type").alias("kind"), fi.issn_set(clean_issns("issn")).alias("their_set"))
    m = merged(s, d).select("rec_no", fi.identifier_status(F.regexp_replace("issn", "[–‐‑]", "-")).alias("ids"), fi.issn_set(clean_issns("issn")).alias("my_set"))
    hits = j07(s, d).select("rec_no", F.filter(F.split("candidate_ids", r"\|"), lambda v: v != "").alias("c"))
    rows = m.join(hits, "rec_no").join(kept, (F.size("c") == 1) & (F.get("c", F.lit(0)) == F.col("sid")), "left")
    return rows.select("rec_no", fm.identity_outcome(F.col("ids"), F.size("c"), F.col("kind"), F.col("my_set"), F.col("their_set")).alias("outcome"))


@query("t01_event_windows", """select date_trunc('hour', ts) as window_start, event_type, count(*) as n_events, round(sum(value), 4) as sum_value from events group by 1, 2""")
def t01(s, d):
    from colophon.streaming.incremental import event_windows

    return event_windows(table(s, d, "events"), "ts", "1 hour", "2 hours", "event_type")
