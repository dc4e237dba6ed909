"""Several values packed in one field: one row per value, its position kept.

Quoted spans are replaced by placeholders that carry their index and that no
text of the cell can be taken for (its own marks are escaped), the rest is split at the cell's own separators, the spans
are put back by array lookup, and the values come out with their positions. All
of it is JVM expressions in one pass; only the comma question (below) needs an
aggregate over the table.

Rules. A list literal gives the strings it denotes. Else ``;``, ``|``, ``/``
and line breaks part a cell; where none of these stands outside quotes, commas
do. A cell parted only by one comma may be one name ("Congo, Democratic
Republic of"): it is, if its second half is a *qualifier*, that is, if over the
whole table that text follows a comma inside undoubted values and never stands
alone as a value. Codes (``blank_parts=True``, for ISSNs) hold neither blanks
nor separators, so any of them parts the cell, quotes or not.

Defined results: a null or empty cell and a cell of blanks or separators only
has no values; ties and repeats keep their positions; texts of any length are
split whole; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colophon.operators.record_tokenizer import literal_items
from colophon.session import spread

#: Begins a placeholder where a digit follows; in the cell's own text, an ``e`` is put after it first, so no text can be taken for one.
MARK, OWN = "\ue000", "\ue000e"
BLANKS = "[\\s\\u00a0\\ufeff]"


def _trim(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\r\n\u00a0\ufeff"))


def _spans(cell: Column) -> Column:
    return F.regexp_extract_all(cell, F.lit(r'("(?:[^"]|"")*+")'), F.lit(1))


def _masked(cell: Column) -> Column:
    """``cell`` with span number i replaced by mark, i and a full stop; marks of its own are escaped."""
    outside = F.split(cell, r'"(?:[^"]|"")*+"', -1)
    own = lambda text: F.replace(text, F.lit(MARK), F.lit(OWN))
    parts = F.transform(
        outside, lambda text, i: F.when(i < F.size(outside) - 1, F.concat(own(text), F.lit(MARK), i.cast("string"), F.lit("."))).otherwise(own(text))
    )
    return F.array_join(parts, "")


def _restored(part: Column, spans: Column) -> Column:
    """A part with its spans back; if it is wholly one span, without the quotes."""
    pieces = F.split(part, MARK + "(?=[0-9])", -1)
    own = lambda text: F.replace(text, F.lit(OWN), F.lit(MARK))
    after = lambda p: F.substring(p, F.instr(p, ".") + 1, F.length(p))
    span = lambda p: F.get(spans, F.substring_index(p, ".", 1).try_cast("int"))
    second = F.get(pieces, F.lit(1))
    whole = (F.size(pieces) == 2) & (F.get(pieces, F.lit(0)) == "") & (after(second) == "")
    bare = F.replace(F.substring(span(second), F.lit(2), F.length(span(second)) - 2), F.lit('""'), F.lit('"'))
    mixed = F.array_join(F.transform(pieces, lambda p, i: F.when(i > 0, F.concat(span(p), own(after(p)))).otherwise(own(p))), "")
    return F.when(~F.contains(part, F.lit(MARK)), part).when(whole, _trim(bare)).otherwise(mixed)


def _is_literal(cell: Column) -> Column:
    trimmed = F.trim(cell)
    return trimmed.startswith("[") & trimmed.endswith("]")


def _qualifier_of(text: Column) -> Column:
    """The text by which halves of names are compared: lower case, no additions in brackets, no punctuation."""
    base = F.regexp_replace(F.lower(text), r"\s*\([^()]*\)\s*$|\s+-\s.*$", "")
    return F.trim(F.regexp_replace(base, r"[^\p{L}\p{N}]+", " "))


def _code_parts(cell: Column) -> Column:
    loose = F.split(F.regexp_replace(cell, r"""["'\[\]]""", " "), f"(?:[;|/,]|{BLANKS})+")
    return F.filter(loose, lambda v: v != "")


def _with_parts(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_items``, the values of ``_cell``; a lone comma counts as a separator here.

    In steps, so that nothing is computed twice: an expression that is used more
    than once isn't merged into its users.
    """
    keep, c = [x for x in rows.columns if x != "_cell"], F.col("_cell")
    marked = rows.withColumns({"_quoted": F.contains(c, F.lit('"')), "_literal": _is_literal(c)})
    masked = marked.withColumn("_masked", F.when(F.col("_quoted") & ~F.col("_literal"), _masked(c)).otherwise(c))
    sep = F.when(F.col("_masked").rlike(r"[;|/\n\r]"), F.split("_masked", r"[;|/\n\r]+")).when(
        F.contains("_masked", F.lit(",")), F.split("_masked", ",")
    )
    split = masked.withColumns(
        {
            "_split": F.when(F.col("_literal"), literal_items(c)).otherwise(F.coalesce(sep, F.array("_masked"))),
            "_spans": F.when(F.col("_quoted") & ~F.col("_literal"), _spans(c)),
        }
    )
    back = lambda p: _restored(p, F.col("_spans"))
    items = F.transform("_split", _trim)
    items = F.when(F.col("_spans").isNotNull(), F.transform(items, back)).otherwise(items)
    return split.select(*keep, "_cell", F.filter(items, lambda v: v != "").alias("_items"))


def _one_comma(cell: Column) -> Column:
    """Parted by a single comma and nothing else: one name or two."""
    other = F.length(F.translate(cell, ';|/"\n\r[]', "")) == F.length(cell)
    halves = [F.btrim(F.substring_index(cell, ",", k), F.lit(" \t\u00a0\ufeff")) != "" for k in (1, -1)]
    return F.contains(cell, F.lit(",")) & (F.length(F.translate(cell, ",", "")) == F.length(cell) - 1) & other & halves[0] & halves[1]


def _cells(df: DataFrame, key: str, fields: Sequence[str], codes: Sequence[str], whole: Sequence[str]) -> DataFrame:
    """One row per cell: ``key, _field, _code, _cell``. The table is read once for all its fields."""
    entries = [F.struct(F.lit(f).alias("_field"), F.lit(f in codes).alias("_code"), F.col(f).alias("_cell")) for f in dict.fromkeys((*fields, *codes))]
    df = spread(df.select(*dict.fromkeys((key, *fields, *codes))))
    rows = df.select(F.col(key).alias(key), F.explode(F.array(*entries)).alias("_f")).select(key, "_f._field", "_f._code", "_f._cell")
    rows = rows.where(F.col("_cell").isNotNull())
    return rows.where(~F.trim("_cell").isin(*whole)) if whole else rows


def comma_qualifiers(cells: DataFrame) -> DataFrame:
    """(``_field``, ``qualifier``): texts that follow a comma inside undoubted values of a field and never stand alone in it.

    Undoubted are all cells but those parted by one comma only. Counted over the
    whole table, with map-side combining; one row per text leaves a task.
    """
    rows = cells.where(~F.col("_code") & ~_one_comma(F.col("_cell"))).select("_field", "_cell")
    values = _with_parts(rows).select("_field", F.explode_outer("_items").alias("value")).where("value is not null")
    inside = F.contains("value", F.lit(","))
    seen = values.select(
        "_field", _qualifier_of(F.when(inside, F.substring_index("value", ",", -1)).otherwise(F.col("value"))).alias("qualifier"),
        inside.cast("int").alias("inside"),
    )
    counts = seen.groupBy("_field", "qualifier").agg(F.sum("inside").alias("inside"), F.count("*").alias("n"))
    return counts.where((F.col("inside") > 1) & (F.col("inside") == F.col("n")) & (F.col("qualifier") != "")).select("_field", "qualifier")


def split_fields(df: DataFrame, key: str, fields: Sequence[str], codes: Sequence[str] = (), whole: Sequence[str] = (), qualifiers: DataFrame | None = None) -> DataFrame:
    """``key``, ``field_name``, ``n_items``, ``pos_no`` from 1, ``item`` for every value of every cell of several fields.

    ``codes``: fields whose values hold neither blanks nor separators. ``whole``:
    cells that mean "nothing" ("-"). ``qualifiers`` as from ``comma_qualifiers``
    (default: learned from ``df``); they are joined only with the cells parted by
    one comma.
    """
    cells, c = _cells(df, key, fields, codes, whole), F.col("_cell")
    doubt = ~F.col("_code") & _one_comma(c)
    parts = []
    if codes:
        parts.append(cells.where("_code").select(key, "_field", _code_parts(c).alias("_items")))
    if fields:
        parts.append(_with_parts(cells.where(~F.col("_code") & ~doubt)).select(key, "_field", "_items"))
        doubtful = cells.where(doubt).withColumn("qualifier", _qualifier_of(F.substring_index("_cell", ",", -1)))
        known = (comma_qualifiers(cells) if qualifiers is None else qualifiers).withColumn("_one", F.lit(True))
        halves = F.filter(F.transform(F.split(c, ","), _trim), lambda v: v != "")
        items = F.when(F.col("_one"), F.array(_trim(c))).otherwise(halves)
        parts.append(doubtful.join(known, ["_field", "qualifier"], "left").select(key, "_field", items.alias("_items")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _exploded(out.withColumnRenamed("_field", "field_name"), key, "field_name")


def split_values(
    df: DataFrame, key: str, field: str, blank_parts: bool = False, qualifiers: DataFrame | None = None, whole: Sequence[str] = ()
) -> DataFrame:
    """As ``split_fields`` for one field, without its name. ``blank_parts``: the field holds codes."""
    known = None if qualifiers is None else qualifiers.select(F.lit(field).alias("_field"), "qualifier").distinct()
    return split_fields(df, key, () if blank_parts else (field,), (field,) if blank_parts else (), whole, known).drop("field_name")


def _exploded(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per value. The outer form and the struct keep filters above the generator.

    Otherwise ``size(_items) > 0`` and tests on ``n_items`` would be pushed below
    it and the whole splitting be computed once more for each.
    """
    packed = F.transform("_items", lambda v, i: F.struct(F.size("_items").alias("n_items"), (i + 1).alias("pos_no"), v.alias("item")))
    return rows.select(*keys, F.explode_outer(packed).alias("_v")).select(*keys, "_v.*").where(F.col("item").isNotNull())
