"""Schemas that drift between files: rescue-column ingestion and the changes it shows.

Each file is loaded against a target schema. Fields the target doesn't know and
values that don't cast aren't lost but kept in the *rescue column* (a map, JSON
on output). Once a field is approved, its rescued values are replayed into a
typed column.

``detect_changes`` takes as target of each file the columns of the file before
it: what is rescued was added, what stays unfilled was removed, and a rescued
field whose values, for the works present in both files, equal those of an
unfilled one is that column under a new name. A column's type changed if not all
its cells cast to the type it had, or all cast to a narrower one.

Each line is tokenised once; the records are written with their rescue columns,
and the changes come from two aggregates of them, by file and column and by file
and work. Neither a run nor a file that holds a third of all lines ends up in one
task. Only the order of the files of a run (one row per file) is a window over
the run.

Defined results: short lines are filled up with empty cells, surplus cells and
lines with broken quoting are rescued under ``_surplus`` / ``_raw``; of headers
that are alike after normalisation the first one counts; files of one date are
ordered by ``file_id``; a column without any value fits the narrowest type,
integer; an empty table gives an empty result; further input columns are not
read.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colophon.operators.record_tokenizer import split_cells
from colophon.session import join_split, written

FILE = ("run_id", "file_id")
TYPES = ("integer", "decimal", "boolean", "date", "string")
SQL_TYPES = {"integer": "bigint", "decimal": "double", "boolean": "boolean", "date": "date", "string": "string"}


def normal_name(name: Column) -> Column:
    """Lower case, without blanks, quotes and byte-order marks."""
    return F.lower(F.regexp_replace(name, "[\\s\\u00a0\\ufeff\"'`“”‘’]+", ""))


def has_value(cell: Column) -> Column:
    text = F.trim(F.coalesce(cell, F.lit("")))
    return (text != "") & (text != "\\N")


def _fits(cell: Column) -> dict[str, Column]:
    v = F.trim(cell)
    date = v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(v, "yyyy-MM-dd").isNotNull()
    return {
        "integer": v.rlike(r"^[+-]?[0-9]+$"),
        "decimal": v.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"),
        "boolean": F.lower(v).isin("true", "false"),
        "date": date,
    }


def files_of(lines: DataFrame) -> DataFrame:
    """``run_id, file_id, file_name, file_date, header`` (normalised), ``columns`` (each name once), ``n_lines``: one row per file."""
    head = split_cells(lines.where(F.col("line_no") == 1).select(*FILE, "file_name", "file_date", "raw_line"), "raw_line")
    names = F.transform(F.coalesce("cells", F.split("raw_line", ",")), normal_name)
    sizes = lines.groupBy(*FILE).agg(F.count("*").alias("n_lines"))
    return head.select(*FILE, "file_name", "file_date", names.alias("header")).withColumn("columns", F.array_distinct("header")).join(sizes, list(FILE))


def in_order(files: DataFrame) -> DataFrame:
    """``files`` with the file before and after each in its run (null at the ends) and their columns. One row per file, so a window over the run holds few."""
    w = Window.partitionBy("run_id").orderBy("file_date", "file_id")
    return files.withColumns(
        {
            "before_id": F.lag("file_id").over(w), "before_columns": F.lag("columns").over(w),
            "next_id": F.lead("file_id").over(w), "next_columns": F.lead("columns").over(w),
        }
    )


def _entries(value: Callable[[Column], Column]) -> Column:
    """Map entries of the columns of ``header``: of names alike the first, with ``value`` of its index."""
    h = F.col("header")
    first = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.array_position(h, F.get(h, i)) == i + 1)
    return F.transform(first, lambda i: F.struct(F.get(h, i).alias("k"), value(i).alias("v")))


def load_works(lines: DataFrame, files: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``run_id, file_id``, ``keep`` (columns of ``files``), ``work_id``, ``fields`` of each line but the first.

    ``fields`` maps column -> cell as written; the key of surplus cells is
    ``_surplus``, of a line that can't be cut ``_raw``. Each line is tokenised
    once, and no file's lines are gathered in one task.
    """
    body = lines.where(F.col("line_no") > 1).select(*FILE, "raw_line")
    side = files.select(*FILE, "header", *keep, "n_lines")
    total = files.agg(F.sum("n_lines")).first()[0] or 0
    cut = split_cells(join_split(body, side, FILE, "n_lines", total), "raw_line")
    h, c = F.col("header"), F.col("cells")
    surplus = F.when(
        F.size(c) > F.size(h),
        F.array(F.struct(F.lit("_surplus").alias("k"), F.array_join(F.slice(c, F.size(h) + 1, F.size(c)), ",").alias("v"))),
    ).otherwise(F.array().cast("array<struct<k:string,v:string>>"))
    broken = F.array(F.struct(F.lit("_raw").alias("k"), F.col("raw_line").alias("v")))
    cells = _entries(lambda i: F.coalesce(F.get(c, i), F.lit("")))
    fields = F.map_from_entries(F.when(c.isNull(), broken).otherwise(F.concat(cells, surplus)))
    return cut.select(*FILE, *keep, F.trim(F.get(c, F.array_position(h, F.lit("id")).cast("int") - 1)).alias("work_id"), fields.alias("fields"))


def rescue(lines: DataFrame) -> DataFrame:
    """Every line of every file enforced against the columns of the file before, and of the file after it.

    ``run_id, file_id, before_id, next_id, work_id, is_head, fields``; ``rescued``:
    fields that the file before doesn't have; ``unfilled``: fields that the file
    after doesn't have and that its works therefore leave unfilled; both null at
    the ends of a run. The header is a record as well (``is_head``, empty cells),
    so that a file without works shows its columns.
    """
    files = written(in_order(files_of(lines)))
    keep = ("before_id", "next_id", "before_columns", "next_columns")
    works = load_works(lines, files, keep).withColumn("is_head", F.lit(False))
    heads = files.select(*FILE, *keep, F.lit(None).cast("string").alias("work_id"), F.map_from_entries(_entries(lambda i: F.lit(""))).alias("fields"), F.lit(True).alias("is_head"))
    beyond = lambda columns: F.map_filter("fields", lambda k, v: ~F.array_contains(columns, k))
    return written(
        works.unionByName(heads).select(
            *FILE, "before_id", "next_id", "work_id", "is_head", "fields",
            F.when(F.col("before_id").isNotNull(), beyond("before_columns")).alias("rescued"),
            F.when(F.col("next_id").isNotNull(), beyond("next_columns")).alias("unfilled"),
        )
    )


def column_types(records: DataFrame) -> DataFrame:
    """``run_id, file_id, before_id, next_id, column_name, column_type``: the narrowest type that all cells with a value cast to."""
    by = [*FILE, "before_id", "next_id", "column_name"]
    cells = records.select(*by[:-1], F.explode("fields").alias("column_name", "cell"))
    full = has_value(F.col("cell"))
    fits = {k: F.coalesce(F.min(F.when(full, e)), F.lit(True)).alias(k) for k, e in _fits(F.col("cell")).items()}
    kind = F.lit("string")
    for name in reversed(TYPES[:-1]):
        kind = F.when(F.col(name), name).otherwise(kind)
    return cells.groupBy(*by).agg(*fits.values()).select(*by, kind.alias("column_type"))


def _renamed(records: DataFrame) -> DataFrame:
    """``run_id, file_id, column_name, new_name``: an unfilled field of the file before whose values, work by work, are those of a rescued field.

    A field's values of all works in both files are summed up in one hash, so
    fields are never compared in pairs.
    """
    works = records.where(~F.col("is_head"))
    now = works.where(F.size("rescued") > 0).select(*FILE, "work_id", "rescued", F.lit(None).cast("map<string,string>").alias("unfilled"))
    then = works.where(F.size("unfilled") > 0).select("run_id", F.col("next_id").alias("file_id"), "work_id", F.lit(None).cast("map<string,string>").alias("rescued"), "unfilled")
    both = now.unionByName(then).where("work_id is not null").groupBy(*FILE, "work_id").agg(F.first("rescued", True).alias("rescued"), F.first("unfilled", True).alias("unfilled"))
    both = both.where("rescued is not null and unfilled is not null")
    entries = lambda c, old: F.transform(F.map_entries(c), lambda e: F.struct(F.lit(old).alias("old"), e["key"].alias("name"), e["value"].alias("cell")))
    long = both.select(*FILE, "work_id", F.explode(F.concat(entries("unfilled", True), entries("rescued", False))).alias("e")).select(*FILE, "work_id", "e.*")
    value = F.when(has_value(F.col("cell")), F.trim("cell"))
    sums = long.groupBy(*FILE, "old", "name").agg(
        F.sum(F.xxhash64("work_id", value).cast("decimal(20,0)")).alias("sum"), F.sum(F.hash("work_id", value, F.lit(1)).cast("bigint")).alias("check"), F.count(value).alias("n")
    )
    sums = written(sums.where("n > 0"))
    same = [*FILE, "sum", "check", "n"]
    fit = sums.where("old").select(*same, F.col("name").alias("column_name")).join(sums.where("not old").select(*same, F.col("name").alias("new_name")), same)
    alike = F.levenshtein("column_name", "new_name") / F.greatest(F.length("column_name"), F.length("new_name"))
    best = lambda side, other: F.row_number().over(Window.partitionBy(*FILE, side).orderBy(F.desc("n"), alike, other))
    ranked = fit.withColumns({"_o": best("column_name", "new_name"), "_n": best("new_name", "column_name")})
    return ranked.where("_o = 1 and _n = 1").select(*FILE, "column_name", "new_name")


def detect_changes(lines: DataFrame) -> DataFrame:
    """``run_id, file_id, change_kind, column_name, new_name`` of each file against the one before it."""
    records = rescue(lines)
    renamed = written(_renamed(records))
    heads = records.where("is_head")
    added = heads.select(*FILE, F.explode(F.map_keys("rescued")).alias("new_name")).join(renamed, [*FILE, "new_name"], "left_anti")
    gone = heads.where("next_id is not null").select("run_id", F.col("next_id").alias("file_id"), F.explode(F.map_keys("unfilled")).alias("column_name"))
    removed = gone.join(renamed, [*FILE, "column_name"], "left_anti")
    types = column_types(records)
    sides = F.array(
        F.struct(F.when(F.col("before_id").isNotNull(), F.col("file_id")).alias("file_id"), F.lit("now").alias("side")),
        F.struct(F.col("next_id").alias("file_id"), F.lit("then").alias("side")),
    )
    both = types.select("run_id", F.explode(sides).alias("p"), "column_name", "column_type").select("run_id", "p.*", "column_name", "column_type").where("file_id is not null")
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("column_type"))).alias(side)
    retyped = both.groupBy(*FILE, "column_name").agg(of("now"), of("then")).where("now != then and column_name not in ('_surplus', '_raw')")
    blank = F.lit("")
    row = lambda kind, name, new: [*FILE, F.lit(kind).alias("change_kind"), name.alias("column_name"), new.alias("new_name")]
    return (
        added.select(*row("added", F.col("new_name"), blank))
        .unionByName(removed.select(*row("removed", F.col("column_name"), blank)))
        .unionByName(renamed.select(*row("renamed", F.col("column_name"), F.col("new_name"))))
        .unionByName(retyped.select(*row("type_changed", F.col("column_name"), blank)))
    )


def ingest(lines: DataFrame, target: Mapping[str, str]) -> DataFrame:
    """One consistent table: a typed column per target column and ``rescued`` as map.

    ``target``: column -> one of ``TYPES``. A value that doesn't cast is null in
    its column and kept in ``rescued`` under its name.
    """
    works = load_works(lines, written(files_of(lines)))
    typed = {c: _cast(F.col("fields")[c], t) for c, t in target.items()}
    lost = F.map_filter(
        "fields", lambda k, v: has_value(v) & (~k.isin(*target) | _any([(k == c) & _cast(v, t).isNull() for c, t in target.items()]))
    )
    return works.select(*FILE, "work_id", *[e.alias(c) for c, e in typed.items()], lost.alias("rescued"))


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def _cast(cell: Column, kind: str) -> Column:
    v = F.when(has_value(cell), F.trim(cell))
    return v.try_cast(SQL_TYPES[kind]) if kind in ("string", "boolean") else F.when(_fits(v)[kind], v).try_cast(SQL_TYPES[kind])


def promote(table: DataFrame, approved: Mapping[str, str]) -> DataFrame:
    """Replay rescued values: each approved field fills the nulls of the typed column it belongs to.

    ``approved``: rescued field -> column of the table. What casts leaves the
    rescue column; of several fields for one column the first with a value wins.
    """
    kinds = dict(table.dtypes)
    into: dict[str, list[str]] = {}
    for field, column in approved.items():
        into.setdefault(column, []).append(field)
    back = {"bigint": "integer", "double": "decimal", "boolean": "boolean", "date": "date", "string": "string"}
    cast = {f: _cast(F.col("rescued")[f], back[kinds[c]]) for f, c in approved.items()}
    used = F.map_filter(
        "rescued", lambda k, v: ~_any([(k == f) & F.col(c).isNull() & cast[f].isNotNull() for f, c in approved.items()])
    )
    out = {c: F.coalesce(F.col(c), *[cast[f] for f in fields]) for c, fields in into.items()}
    # in two steps: within one, the new columns would already be seen by ``used``
    step = table.withColumn("_left", used).withColumns(out)
    return step.withColumn("rescued", F.col("_left")).drop("_left")


def run_stats(lines: DataFrame) -> DataFrame:
    """What the statistics of each run should say: all files, names normalised, order and case ignored."""
    head = F.col("line_no") == 1
    cut = split_cells(lines.where(head).select("run_id", "file_id", "file_name", "file_date", "raw_line"), "raw_line")
    names = F.array_sort(F.array_distinct(F.transform(F.coalesce("cells", F.split("raw_line", ",")), normal_name)))
    files = cut.select("run_id", "file_name", "file_date", "file_id", names.alias("columns"))
    first = files.groupBy("run_id").agg(F.min_by("columns", F.struct("file_date", "file_id")).alias("first_columns"))
    unique = files.select("run_id", F.explode("columns").alias("c")).distinct()
    unique = unique.groupBy("run_id").agg(F.array_sort(F.collect_set("c")).alias("unique_columns"))
    differ = files.join(first, "run_id").withColumn("differs", F.col("columns") != F.col("first_columns"))
    differ = differ.groupBy("run_id").agg(
        F.count("*").alias("total_files"), (F.count_if("differs") == 0).alias("per_file_columns_same"),
        F.array_sort(F.collect_list(F.when(F.col("differs"), F.col("file_name")))).alias("differing_files"),
    )
    rows = lines.groupBy("run_id").agg(F.count_if(~head).alias("total_rows"))
    return differ.join(rows, "run_id").join(unique, "run_id").select(
        "run_id", "total_files", "total_rows", "unique_columns", "per_file_columns_same", "differing_files"
    )
