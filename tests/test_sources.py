import json
import os
import urllib.error

import pytest

from colophon.plans import report
from colophon.session import join_split
from colophon.sources import artifacts, csv_tree, rest, sinks
from colophon.streaming import incremental


def put(folder, **files):
    for name, text in files.items():
        (folder / f"{name}.csv").write_bytes(text.encode() if isinstance(text, str) else text)
    return str(folder)


def test_union_with_backslash(spark, tmp_path):
    d = put(tmp_path, a="id,title,path\n1,Alpha,C:\\Users\\name\n", b="\ufeffid,abstract\n2,Beta\n")
    df = csv_tree.read_union(spark, d)
    assert df.columns == ["abstract", "id", "path", "title"]
    rows = {r["id"]: (r["abstract"], r["path"], r["title"]) for r in df.collect()}
    assert rows == {"1": (None, "C:Usersname", "Alpha"), "2": ("Beta", None, None)}
    plain = {r["id"]: r["path"] for r in csv_tree.read_union(spark, d, backslash_compat=False).collect()}
    assert plain["1"] == "C:\\Users\\name"


def test_odd_rows(spark, tmp_path):
    d = put(tmp_path, a='a,b\n1\n2,3,4\n"x\ny","q "" r"\n,\n', empty="", head="a,b\n")
    got = sorted((r["a"] or "", r["b"] or "") for r in csv_tree.read_union(spark, d).collect())
    assert got == [("", ""), ("1", ""), ("2", "3"), ("x\ny", 'q " r')]
    union, same, differ, _ = csv_tree.headers(d)
    assert union == ["a", "b"] and not same and [os.path.basename(p) for p in differ] == ["empty.csv"]
    stages = {r["stage"]: r["n_rows"] for r in csv_tree.parity(spark, d, ("merged", csv_tree.read_union(spark, d))).collect()}
    assert stages["a.csv"] == 4 and stages["all files"] == stages["merged"] == 4


def test_guard(tmp_path):
    with pytest.raises(ValueError, match="must be outside the input directory"):
        csv_tree.guard_output(str(tmp_path), str(tmp_path / "x" / "out.parquet"))


def test_sniffed(spark, tmp_path):
    put(tmp_path, **{"sjr 1999 x 2004": "Title;Issn\nÉtudes;1\n".encode("latin-1")})
    df = csv_tree.read_sniffed(spark, str(tmp_path / "sjr 1999 x 2004.csv"))
    r = df.first()
    assert (r["Title"], r["Issn"], r["year"]) == ("Études", "1", 2004)


def test_encoding_of_the_whole_file(spark, tmp_path):
    head = "id;name\n" + "1;" + "x" * 2037
    put(tmp_path, split=f"{head}é\n2;ñandú\n", late=f"{head}yyyyyyy\n2;ñandú\n".encode("latin-1"))
    assert len(head.encode()) == 2047
    for name in ("split", "late"):
        rows = {r["id"]: r["name"] for r in csv_tree.read_sniffed(spark, str(tmp_path / f"{name}.csv")).collect()}
        assert rows["2"] == "ñandú" and rows["1"][-1] in "éy"


def test_verified_sink_and_rollback(spark, tmp_path):
    out = str(tmp_path / "t.parquet")
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, v string")
    sinks.write_verified(df, out)
    assert spark.read.parquet(out).count() == 3
    (tmp_path / "old1").write_text("1")
    (tmp_path / "old2").write_text("2")
    (tmp_path / "new1").write_text("n")
    with pytest.raises(FileNotFoundError):
        sinks.promote(spark, [(str(tmp_path / "new1"), str(tmp_path / "old1")), (str(tmp_path / "absent"), str(tmp_path / "old2"))])
    assert (tmp_path / "old1").read_text() == "1" and (tmp_path / "old2").read_text() == "2"
    sinks.write_single(df.limit(0), str(tmp_path / "none.parquet"))
    assert spark.read.parquet(str(tmp_path / "none.parquet")).columns == ["k", "v"]


def test_artifacts(tmp_path):
    for name, text in (("stable", "x"), ("copy", "x"), ("changed", "y")):
        (tmp_path / name).write_text(text)
    a, b, c = (artifacts.Artifact.of(str(tmp_path / n), "f") for n in ("stable", "copy", "changed"))
    assert a.id == b.id and a.location != b.location and c.id != a.id
    a.verify()
    with pytest.raises(ValueError, match="does not match its sha256"):
        artifacts.Artifact(a.id, "0" * 64, a.location).verify()


def pages(*blocks, count=None):
    blocks = list(blocks)
    total = count if count is not None else sum(map(len, blocks))

    def fetch(url, params):
        i = 0 if params["cursor"] == "*" else int(params["cursor"])
        return {"meta": {"count": total, "next_cursor": str(i + 1) if i + 1 < len(blocks) else None}, "results": blocks[i]}

    return fetch


def test_cursor_pages():
    assert list(rest.cursor_pages(pages([1], [2]), "u", {})) == [1, 2]
    with pytest.raises(ValueError, match="announced"):
        list(rest.cursor_pages(pages([1], count=2), "u", {}))
    with pytest.raises(ValueError, match="came again"):
        list(rest.cursor_pages(lambda u, p: {"meta": {"next_cursor": "*"}, "results": [1]}, "u", {}))


def test_retry_continues_at_the_failed_page():
    calls = []
    good = pages([1], [2], [3])

    def shaky(url, params):
        calls.append(params["cursor"])
        if params["cursor"] == "1" and calls.count("1") < 3:
            raise rest.TemporaryError("429")
        return good(url, params)

    assert list(rest.cursor_pages(shaky, "u", {}, rest.Retry(sleep=lambda s: None))) == [1, 2, 3]


def test_directory_resumes():
    items, kept = list(range(1001)), {}

    def fetch(url, p):
        if p["offset"] == 1000 and not kept.get("again"):
            raise OSError("down")
        return {"message": {"items": items[p["offset"] : p["offset"] + p["rows"]], "total-results": 1001}}

    keep = lambda page, rows: kept.__setitem__(page, rows)
    with pytest.raises(OSError):
        list(rest.directory_pages(fetch, "u", keep=keep))
    kept["again"] = True
    calls = []
    out = list(rest.directory_pages(lambda u, p: calls.append(p) or fetch(u, p), "u", done={k: v for k, v in kept.items() if k != "again"}))
    assert len(out) == 1001 and len(calls) == 1
    with pytest.raises(ValueError, match="page came again"):
        list(rest.directory_pages(lambda u, p: {"message": {"items": [1], "total-results": 3}}, "u", 1))


def test_lookup():
    def gone(url, p):
        raise urllib.error.HTTPError(url, 404, "", {}, None)

    assert rest.lookup(gone, "u", {}) is None and rest.key_batches(["a", "b", "c"], 2) == ["a|b", "c"]


def test_paged_source(spark):
    class Local(rest.PagedSource):
        fetch = staticmethod(lambda url, params: {"meta": {"count": 1}, "results": [{"year": params["year"]}]})

    spark.dataSource.register(Local)
    df = spark.read.format("colophon_pages").option("url", "u").option("slices", '[{"year": 1}, {"year": 2}]').load()
    assert sorted(r["record"] for r in df.collect()) == ['{"year": 1}', '{"year": 2}']


def test_stream_merges_new_files_once(spark, tmp_path):
    src, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    src.mkdir()
    put(src, a="id,t\n1,x\n2,y\n")
    incremental.merge_new_files(spark, str(src), "id string, t string", out, cp, "id").awaitTermination()
    put(src, b="id,t\n2,z\n3,w\n")
    incremental.merge_new_files(spark, str(src), "id string, t string", out, cp, "id").awaitTermination()
    assert sorted((r["id"], r["t"]) for r in spark.read.parquet(out).collect()) == [("1", "x"), ("2", "y"), ("3", "w")]


def test_report_json_is_whole(spark, tmp_path):
    rows = report.MOST_ROWS + 5
    report.write_report({"part": spark.range(rows).selectExpr("id", "if(id = 0, null, 'x') as v")}, str(tmp_path))
    lines = [json.loads(x) for f in (tmp_path / "part.json").glob("part-*") for x in f.read_text().splitlines()]
    assert sorted(r["id"] for r in lines) == list(range(rows)) and all("v" in r for r in lines)


def test_split_join_agrees_with_a_plain_one(spark):
    rows = spark.range(3000).selectExpr("id as r", "if(id % 3 = 0, 'hot', cast(id % 50 as string)) as k")
    side = rows.where("k != '7'").groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "n", "concat(k, '!') as v")
    for how in ("inner", "left"):
        want = {(r["r"], r["v"]) for r in rows.join(side.drop("n"), "k", how).collect()}
        got = join_split(rows, side, ["k"], "n", 3000, how, share=10)
        assert sorted(got.columns) == ["k", "r", "v"] and {(r["r"], r["v"]) for r in got.collect()} == want
