"""Golden values and every query against its SQL."""

import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from colophon.functions import identifiers as fi
from colophon.functions import measures as fm
from colophon.functions import names as fn
from colophon.functions import texts as ft
from colophon.operators import documents as od
from colophon.operators import matching as om
from colophon.queries import found, reference, reference_more

ALL = reference.QUERIES | reference_more.QUERIES
ALL_SQL = reference.SQL | reference_more.SQL | found.SQL


def cells(rows):
    show = lambda v: "null" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.5f}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ALL | {k: found.QUERIES[k] for k in found.SQL}))
def test_query(name, spark, sf, duck):
    df = (ALL | found.QUERIES)[name](spark, sf)
    columns = sorted(df.columns)
    got = cells(df.select(*columns).collect())
    if name in ALL_SQL:
        want = duck.sql(ALL_SQL[name])
        assert sorted(want.columns) == columns
        assert got == cells(want.select(*[f'"{c}"' for c in columns]).fetchall())
    else:
        assert got


def values(spark, expr, rows, schema="v string"):
    return [r[0] for r in spark.createDataFrame([(x,) if not isinstance(x, tuple) else x for x in rows], schema).select(expr).collect()]


def test_issn_rules(spark):
    strict = values(spark, fi.issn_strict(F.col("v")), ["2307-4108", "23074116", "2434-561X", "0000-0000", "1234-5678", "abc", None])
    assert strict == ["2307-4108", "2307-4116", "2434-561X", "0000-0000", None, None, None]
    assert values(spark, fi.issn_tokens(F.col("v")), ["1234-5678, 15405702"]) == [["15405702"]]
    assert values(spark, fi.issn_tokens(F.col("v"), True), ["1234-5678, 15405702"]) == [["12345678", "15405702"]]
    assert values(spark, fi.issn_loose(F.col("v")), ["1234-567", "-", "nan", "12"]) == ["1234567", None, None, None]


def test_doi_and_numbers(spark):
    assert values(spark, fi.doi_normal(F.col("v")), ["https://doi.org/10.1/A b c", "HTTPS://DX.DOI.ORG/10.1/abc", None]) == ["10.1/abc", "10.1/abc", None]
    tc = ["0", "3", "", "{'x'", "12d", "NaN", None]
    assert values(spark, fm.invisibility(F.col("v")), tc) == [1, 0, None, None, None, None, None]
    assert values(spark, fm.invisible(F.col("v")), tc) == [1, 0, 1, 1, 1, 1, 1]


def test_names(spark):
    assert fn.canonical_field("Ada Lovelace, Alan Turing") == "ada lovelace, alan turing" and fn.canonical_field(None) == ""
    assert fn.canonical("Dr. José van der Berg Jr.") == "jose van der berg"
    assert fn.last_first("ada m lovelace") == "Lovelace, Ada M" and fn.last_first("Doe ,  J") == "Doe, J"
    assert values(spark, fn.author_count(F.col("v")), ["Ada Lovelace", "Alan Turing & Joan Clarke", None, " "]) == [1, 2, 0, 0]
    words = ["Cabrandes; Thornavel; Okanduro", "Ferdinand Sandoval AND Anders Land", "A and and B", "A+B/C\\D;;", "Éand and Bandé"]
    assert values(spark, fn.author_count(F.col("v")), words) == [3, 2, 2, 4, 2]


def test_literals(spark):
    got = values(spark, ft.struct_list(F.col("v"), "id string, x string"), ["[{'id': 'ur.1', 'x': None}]", '[{"id": "b"}]', "nan", "[]"])
    assert [None if g is None else [r["id"] for r in g] for g in got] == [["ur.1"], ["b"], None, []]


def test_first_author(spark):
    rows = [("[{'id': 'ur.1'}]", None), (None, "[{'author_id': 'ur.2'}]"), ("[{'ids': [{'dimensions_id': 'ur.3'}]}]", None), ("[{'first_name': 'x'}]", None)]
    df = spark.createDataFrame(rows, "researchers string, authors string")
    assert [r[0] for r in df.select(reference.first_author()).collect()] == ["ur.1", "ur.2", "ur.3", None]


def test_shared_key_match(spark):
    left = spark.createDataFrame([(1, []), (2, ["x"]), (3, ["2307-4116"]), (4, ["2307-4116", "2049-3630"])], "k int, ks array<string>")
    right = spark.createDataFrame([("c1", ["2307-4108", "2307-4116"]), ("c2", ["2049-3630"])], "id string, ks array<string>")
    got = {r["k"]: (r["status"], r["matched_keys"], r["candidate_ids"]) for r in om.shared_key_match(left, "k", F.col("ks"), right, "id", F.col("ks")).collect()}
    assert got == {
        1: ("not_attempted", "", ""), 2: ("unmatched", "", ""), 3: ("unique", "2307-4116", "c1"), 4: ("ambiguous", "2049-3630|2307-4116", "c1|c2"),
    }


def test_near_match_against_brute_force(spark):
    a = ["university of northhurst", "univ of northhurst", "northurst university", "abc", "abd", "university of northhurts"]
    b = ["university of northhurst", "abc", "university of ravenwick"]
    left, right = spark.createDataFrame(list(enumerate(a)), "k int, n string"), spark.createDataFrame([(x,) for x in b], "e string")
    got = {(r["k"], r["entry"]) for r in om.near_match(left, "k", "n", right, "e").collect()}
    want = set()
    for i, x in enumerate(a):
        score, best = max((om.indel_ratio(x, y), y) for y in b)
        if score >= 92:
            want.add((i, best))
    assert got == want


def test_expansion(spark):
    m = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (3, [])], "k int, ids array<string>")
    c = spark.createDataFrame([("a", "A"), ("b", "B")], "cid string, title string")
    got = {r["k"]: (r["title"], r["candidates_json"]) for r in om.expand_candidates(m, "k", F.col("ids"), c, "cid", ["title"]).collect()}
    assert got[1] == ("A", None) and got[2][0] is None and got[2][1].count("title") == 2 and got[3] == (None, None)


OAI = '<r xmlns:dc="http://purl.org/dc/elements/1.1/"><h><identifier>no</identifier></h><dc:title>{}</dc:title><dc:title>two</dc:title></r>'


def test_xml(spark):
    df = spark.createDataFrame([(1, OAI.format("one")), (2, OAI.format("")), (3, "<broken"), (4, None)], "k int, x string")
    got = {r["k"]: (r["title"], r["identifier"]) for r in od.oai_fields(df, "x").collect()}
    assert got == {1: ("one", None), 2: (None, None), 3: (None, None), 4: (None, None)}
    tags = {r["tag"].split("}")[-1]: (r["n_documents"], r["example"]) for r in od.tag_census(df, "k", "x").collect()}
    assert tags["title"] == (2, "one")


def test_inverted_index(spark):
    df = spark.sql("select map('b', array(1, 4), 'a', array(0, 1)) as m")
    assert od.with_abstract(df, "m").first()["abstract"] == "a b b"
    long = spark.sql("select map('w', sequence(0, 29999)) as m, 'clash' as w")
    assert od.with_abstract(long, "m", "text").first()["text"] == " ".join(["w"] * 30_000)
    assert od.with_abstract(spark.sql("select cast(null as map<string, array<int>>) as m"), "m").first()["abstract"] is None


def test_paths_through_lists(spark):
    docs = ['{"a": [{"b": 1}, {"b": 2}, {"c": 3}]}', '{"a": {"b": "x"}}', '{"a": [[{"b": [1, 2]}], {"b": "é"}]}', '{"a": []}', '{"a": {"b": {"c": true}}}', "no [json", None, "{}"]
    got = values(spark, od.json_path(F.col("v"), "a.b"), docs)
    assert got == ["[1, 2, null]", "x", '[1, 2, "é"]', "[]", '{"c":true}', None, None, None]


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["src_table", "row_id", "reason"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
