"""Identifiers: ISSN in three rules, DOI, hosts. Column expressions; no Python workers.

The three ISSN rules differ on purpose and keep separate names: *strict* checks
the check digit, *loose* keeps any seven characters or more, *tokens* are runs
of exactly eight.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the seven digits of an ISSN in its check sum.
ISSN_WEIGHTS = (8, 7, 6, 5, 4, 3, 2)


def is_missing(c: Column) -> Column:
    """Null, blank, or the text NA."""
    return c.isNull() | F.upper(F.trim(c)).isin("", "NA")


def issn_strict(c: Column) -> Column:
    """``NNNN-NNNC`` if the check digit fits, else null."""
    bare = F.regexp_replace(F.upper(F.trim(c)), "[^0-9X]", "")
    digit = lambda i: F.substring(bare, i, 1).try_cast("int")
    total = sum((digit(i + 1) * w for i, w in enumerate(ISSN_WEIGHTS)), F.lit(0))
    want = F.pmod(F.lit(11) - total % 11, F.lit(11))
    check = F.when(want == 10, "X").otherwise(want.cast("string"))
    return F.when(
        bare.rlike("^[0-9]{7}[0-9X]$") & (F.substring(bare, 8, 1) == check),
        F.concat(F.substring(bare, 1, 4), F.lit("-"), F.substring(bare, 5, 4)),
    )


def issns_strict(c: Column) -> Column:
    """Valid ISSNs of a cell, each once, in order; missing gives an empty array."""
    parts = F.split(F.when(is_missing(c), "").otherwise(c), r"[\s,;|]+")
    return F.array_distinct(F.filter(F.transform(parts, issn_strict), lambda v: v.isNotNull()))


def issn_loose(c: Column) -> Column:
    """Upper case, letters and digits only, seven or more; placeholders are null."""
    bare = F.regexp_replace(F.upper(F.trim(c)), r"[^\p{L}\p{N}]", "")
    placeholder = F.upper(F.trim(c)).isin("", "-", "NA", "NAN")
    return F.when(~placeholder & (F.length(bare) >= 7), bare)


def issns_loose(c: Column) -> Column:
    parts = F.split(F.coalesce(c, F.lit("")), r"[;,|/\s]+")
    return F.array_distinct(F.filter(F.transform(parts, issn_loose), lambda v: v.isNotNull()))


def issn_tokens(c: Column, hyphen_aware: bool = False) -> Column:
    """Runs of eight. A hyphen parts runs unless ``hyphen_aware``."""
    text = F.coalesce(c, F.lit(""))
    text = F.regexp_replace(text, r"([0-9]{4})-([0-9]{3}[0-9Xx])", "$1$2") if hyphen_aware else text
    runs = F.regexp_extract_all(text, F.lit(r"([0-9A-Za-z]+)"), F.lit(1))
    bare = F.transform(runs, lambda t: F.regexp_replace(F.upper(t), "[^0-9X]", ""))
    return F.array_distinct(F.filter(bare, lambda t: F.length(t) == 8))


def issn_set(values: Column) -> Column:
    """Sorted, each once, joined by bars."""
    return F.array_join(F.array_sort(F.array_distinct(values)), "|")


def issn_state(c: Column) -> Column:
    """What is in place of a valid ISSN."""
    return (
        F.when(c.isNull(), "missing value")
        .when(F.trim(c) == "", "blank string")
        .when(F.upper(F.trim(c)) == "NA", "literal NA")
        .otherwise("present but invalid")
    )


def identifier_status(c: Column) -> Column:
    return F.when(is_missing(c), "missing").when(F.size(issns_strict(c)) == 0, "invalid").otherwise("valid")


def doi_normal(c: Column) -> Column:
    """Lower case, resolver or label dropped, no blanks; empty is null."""
    bare = F.regexp_replace(F.btrim(F.lower(c), F.lit(" \t\r\n\u00a0")), r"^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", "")
    bare = F.regexp_replace(bare, "[\\s\u00a0]+", "")
    return F.when(bare != "", bare)


def host(c: Column, missing: str = "Missing URL") -> Column:
    name = F.regexp_extract(F.lower(c), r"^[a-z][a-z0-9+.-]*://([^/:?#]+)", 1)
    return F.when(is_missing(c) | (name == ""), missing).otherwise(name)
