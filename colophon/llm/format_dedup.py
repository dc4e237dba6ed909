"""Duplicates hidden by formatting: one record per group of copies, with their number.

Records are made canonical (characters: composed and decomposed accents, full-width
signs and ligatures are one; case, blanks, punctuation, order of the fields inside bracketed entries), hashed to 128 bits, and counted per hash with
map-side combining, so that a hash that a third of all rows share leaves each
task as one row. A second, independent 64-bit hash and the length of the
canonical text are part of the key: records that collide in 128 bits but not in
these stay apart, and ``collisions`` reports them.

To name each copy's group, rows are joined with the groups of two or more.
Groups of at least a thousandth of all rows, of which there can't be more than a
thousand, are broadcast; all others are joined by shuffle, where no key has more
than a thousandth of the rows.

Defined results: null, empty and blank values are alike; texts of any length
are hashed whole; among equal keys the smallest ``rec_no`` stands for the group;
an empty table gives an empty result; columns beyond the compared ones are not
read, so clashing names do no harm.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from colophon.session import written

#: Separates fields in the canonical text; a control character that no class below removes.
UNIT = "\u0001"
DROPPED = r"[\p{P}\p{Z}\p{Sk}\p{Cf}\t\n\r\f\u000b\u0085$+<=>|~]+"
DOI_LABEL = r"^[\W_]*(?:(?:https?[\W_]*)?(?:(?:www|dx)\.)?doi\.org[\W_]*|(?:info|urn)\W*doi[\W_]*|doi[\W_]*)+"
HOT_SHARE = 1000


#: Forms of one character: full-width signs, ligatures, and marks that follow their letter.
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).lower()
LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "st", "\ufb06": "st"}
FORMS = "[\uff01-\uff5e\ufb00-\ufb06]"
MARKS = r"\p{M}"


def _folded(text: Column) -> Column:
    """Full-width signs and ligatures as the plain letters; only texts that hold one pay for it."""
    plain = F.translate(text, WIDE, NARROW)
    for a, b in LIGATURES.items():
        plain = F.replace(plain, F.lit(a), F.lit(b))
    return F.when(text.rlike(FORMS), plain).otherwise(text)


@F.arrow_udf(StringType())
def composed(text: pa.Array) -> pa.Array:
    """Letters and the marks after them as one character, where there is one."""
    if text.null_count == len(text):
        return text.cast(pa.string())
    return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in text.to_pylist()], pa.string())


def _entries(text: Column) -> Column:
    """Bracketed entries with the fields of each in a fixed order.

    A comma parts fields only where a colon follows before the next comma, so
    that commas inside values stay with their field.
    """
    fields = lambda e: F.array_join(F.array_sort(F.transform(F.split(e, r",(?=[^,:]*:)"), lambda f: F.regexp_replace(f, DROPPED, ""))), UNIT)
    found = F.regexp_extract_all(text, F.lit(r"\{([^{}]*)\}"), F.lit(1))
    outside = F.regexp_replace(text, r"\{[^{}]*\}", "")
    return F.concat(F.array_join(F.transform(found, fields), UNIT), outside)


def canonical(plain: Sequence[str], entries: Sequence[str] = (), doi: Sequence[str] = ()) -> Column:
    """The text of a record before ``keyed`` folds it. Fields of bracketed entries are sorted, labels before a DOI dropped."""
    low = lambda c: F.replace(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("ß"), F.lit("ss"))
    parts = [F.regexp_replace(low(c), DOI_LABEL, "") for c in doi] + [low(c) for c in plain]
    parts += [F.when(F.contains(low(c), F.lit("{")), _entries(low(c))).otherwise(low(c)) for c in entries]
    return F.concat_ws(UNIT, *parts)


def keyed(df: DataFrame, key: str, text: Column) -> DataFrame:
    """``key`` with ``h128`` (16 bytes) and ``check`` (an independent hash and the length) of the canonical text.

    Only texts that hold a combining mark are sent to a Python worker, to be composed.
    """
    step = df.select(key, text.alias("_text")).withColumn("_text", _folded(F.col("_text")))
    step = step.withColumn("_text", F.regexp_replace("_text", DROPPED, ""))
    step = step.withColumn("_text", F.coalesce(composed(F.when(F.col("_text").rlike(MARKS), F.col("_text"))), F.col("_text")))
    return step.select(
        key, F.unhex(F.md5(F.encode("_text", "utf-8"))).alias("h128"),
        F.struct(F.xxhash64("_text").alias("h64"), F.length("_text").alias("n")).alias("check"),
    )


def groups(hashed: DataFrame, key: str) -> DataFrame:
    """One row per distinct record: ``h128, check, first_key, n_copies``."""
    return hashed.groupBy("h128", "check").agg(F.min(key).alias("first_key"), F.count("*").alias("n_copies"))


def collisions(grouped: DataFrame) -> DataFrame:
    """Hashes that different records share: ``h128, n_records``."""
    return grouped.groupBy("h128").agg(F.count("*").alias("n_records")).where("n_records > 1")


def copies(hashed: DataFrame, key: str, share: int = HOT_SHARE) -> DataFrame:
    """``first_key, key, n_copies`` for each record that is another's copy.

    The hashes are written to the shared folder once, since they are used twice;
    the texts never leave their partition.
    """
    hashed = written(hashed)
    several = written(groups(hashed, key).where("n_copies > 1"))
    hot_from = F.lit(max(2, hashed.count() // share))
    ends = []
    for hot in (True, False):
        side = several.where(F.col("n_copies") >= hot_from if hot else F.col("n_copies") < hot_from)
        ends.append(hashed.join(F.broadcast(side) if hot else side, ["h128", "check"]))
    return ends[0].unionByName(ends[1]).where(F.col(key) != F.col("first_key")).select("first_key", key, "n_copies")


def collapse(df: DataFrame, key: str, text: Column) -> DataFrame:
    """``df`` with one record per group, the one of the smallest key, and ``n_copies``."""
    first = groups(keyed(df, key, text), key).select(F.col("first_key").alias(key), "n_copies")
    return df.join(first, key)
