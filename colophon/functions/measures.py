"""Derived variables, states and scores. Column expressions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colophon.functions.identifiers import is_missing
from colophon.functions.texts import number

#: Words in an author field that speak of a body or a contact.
BODY_WORDS = (
    "university", "college", "institute", "department", "faculty", "hospital", "center", "centre", "school", "laboratory", "lab",
    "email", "@", "phone", "tel", "orcid", "doi", "www", "http", "大学", "学院", "研究所", "医院", "中心", "实验室",
)
WEIGHTS = {"identification": 0.3, "separation": 0.25, "classification": 0.25, "formatting": 0.2}


def invisibility(times_cited: Column) -> Column:
    """1 for zero citations, 0 for others, null where there is no number."""
    n = number(times_cited)
    return F.when(n == 0, 1).when(n.isNotNull(), 0)


def invisible(times_cited: Column) -> Column:
    """As ``invisibility``, but no number counts as uncited."""
    return F.coalesce(invisibility(times_cited), F.lit(1))


def prestige(rank: Column) -> Column:
    return F.when(rank.isNull(), "Unknown").when(rank <= 100, "Elite").when(rank <= 500, "High").when(rank <= 1000, "Medium").otherwise("Low")


def match_status(attempted: Column, n_candidates: Column) -> Column:
    return F.when(~attempted, "not_attempted").when(n_candidates == 0, "unmatched").when(n_candidates == 1, "unique").otherwise("ambiguous")


def comparison_state(left: Column, right: Column) -> Column:
    return F.when(is_missing(left) | is_missing(right), "not_observed").when(left == right, "same").otherwise("different")


def identity_outcome(status: Column, n_candidates: Column, kind: Column, input_set: Column, matched_set: Column) -> Column:
    """The first of six findings that holds."""
    return (
        F.when(status != "valid", "no_valid_issn")
        .when(n_candidates == 0, "valid_issn_unmatched")
        .when(n_candidates > 1, "conflicting_source_ids")
        .when(is_missing(kind) | (F.lower(kind) != "journal"), "non_journal_source")
        .when(input_set != matched_set, "partial_issn_agreement")
        .otherwise("consistent")
    )


def record_band(n: Column) -> Column:
    steps = ((10, "under 10"), (25, "10-24"), (50, "25-49"), (100, "50-99"), (1000, "100-999"))
    out = F.when(n.isNull(), "missing")
    for top, name in steps:
        out = out.when(n < top, name)
    return out.otherwise("1000 or more")


BANDS = ("under 10", "10-24", "25-49", "50-99", "100-999", "1000 or more", "missing")


def capped(n: Column, most: int = 10_000) -> tuple[Column, Column]:
    """(capped value, label)."""
    return F.least(n, F.lit(most)), F.when(n >= most, F.lit(f"{most}+")).otherwise(n.cast("string"))


def complexity(creator: Column, n_authors: Column, has_affiliations: Column) -> Column:
    short = F.length(creator) <= 50
    return F.when(short & (n_authors <= 1) & ~has_affiliations, "simple").when((F.length(creator) <= 200) & (n_authors <= 3), "medium").otherwise("complex")


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of a share; null for n = 0."""
    p, zz = hits / n, z * z
    mid, half = (p + zz / (2 * n)) / (1 + zz / n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return F.when(n > 0, mid - half), F.when(n > 0, mid + half)


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def word_set(c: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", " "), r"\s+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def _parts(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ";"), lambda v: F.trim(v)), lambda v: v != "")


def _any_in(text: Column, words: Sequence[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def score_identification(original: Column, authors: Column) -> Column:
    """1 to 5: are these the same people, by overlap of words and sanity of the names."""
    o, a = F.trim(F.coalesce(original, F.lit(""))), F.trim(F.coalesce(authors, F.lit("")))
    ratio = F.length(a) / F.length(o)
    names = _parts(a)
    odd = F.exists(names, lambda n: ~n.rlike(r"^[A-Za-zÀ-ÿ一-鿿Ѐ-ӿ\s,.-]+$") | (F.length(n) < 2) | (F.length(n) > 100))
    left, right = word_set(o), word_set(a)
    alike = jaccard(left, right)
    by_words = F.when(alike > 0.7, 5).when(alike > 0.5, 4).when(alike > 0.3, 3).otherwise(2)
    return (
        F.when((o == "") | (a == "") | _any_in(F.lower(a), ("*", "???", "unknown", "anonymous")), 1)
        .when((ratio < 0.1) | (ratio > 3) | odd, 2)
        .when((F.size(left) > 0) & (F.size(right) > 0), by_words)
        .otherwise(3)
    )


def score_separation(authors: Column, expected: Column) -> Column:
    """1 to 5: as many names as expected, less for repeats and for very short or long names."""
    names = _parts(F.coalesce(authors, F.lit("")))
    gap = F.abs(F.size(names) - expected)
    base = F.when(gap == 0, 5).when(gap == 1, 4).when(gap <= 2, 3).otherwise(2)
    mean = F.aggregate(names, F.lit(0.0), lambda acc, n: acc + F.length(n)) / F.greatest(F.size(names), F.lit(1))
    repeated = (F.size(F.array_distinct(names)) < F.size(names)).cast("int")
    many = F.greatest(F.lit(1), F.greatest(F.lit(1), base - repeated) - ((mean < 5) | (mean > 50)).cast("int"))
    alone = F.when(F.contains(F.coalesce(authors, F.lit("")), F.lit(";")), 2).otherwise(5)
    return F.when(expected <= 1, alone).otherwise(many)


def score_classification(original: Column, authors: Column, affiliations: Column) -> Column:
    """2 to 5: bodies aren't among the names, and the affiliations are of some length."""
    good = F.size(F.filter(affiliations, lambda x: F.length(F.trim(x)) > 5))
    n = F.size(affiliations)
    none = F.when(_any_in(F.lower(F.coalesce(original, F.lit(""))), BODY_WORDS), 3).otherwise(5)
    return (
        F.when(_any_in(F.lower(F.coalesce(authors, F.lit(""))), BODY_WORDS), 2)
        .when(n == 0, none)
        .when(good == n, 5)
        .when(good > n * 0.7, 4)
        .otherwise(3)
    )


def score_formatting(authors: Column) -> Column:
    """1 to 5: mean over the names of points for ``Last, First``, case and odd characters; half to even."""
    names = _parts(F.coalesce(authors, F.lit("")))

    def one(n: Column) -> Column:
        halves = F.split(n, ",")
        comma = F.when(~F.contains(n, F.lit(",")), 0.0).when(
            (F.size(halves) == 2) & (F.trim(halves[0]) != "") & (F.trim(F.get(halves, F.lit(1))) != ""), 1.0
        ).otherwise(-1.0)
        has_up, has_low = n != F.lower(n), n != F.upper(n)
        case = F.when(has_up & has_low, 0.5).when(has_up | has_low, -1.0).otherwise(0.0)
        odd = F.when(n.rlike(r"[^\p{L}\p{N}_\s,.-]"), -0.5).otherwise(0.0)
        wide = F.when(n.rlike(r"\s{2,}"), -0.5).otherwise(0.0)
        return F.greatest(F.lit(1.0), F.least(F.lit(5.0), F.lit(3.0) + comma + case + odd + wide))

    mean = F.aggregate(F.transform(names, one), F.lit(0.0), lambda acc, s: acc + s) / F.greatest(F.size(names), F.lit(1))
    return F.when(F.size(names) == 0, 1).otherwise(F.bround(mean).cast("int"))


def author_scores(df: DataFrame, keep: Sequence[str], creator: str, names: str, bodies: str, expected: str) -> DataFrame:
    """``keep`` and the four scores of a record's authors: ``identification, separation, classification, formatting``."""
    c = F.col
    return df.select(
        *keep, score_identification(c(creator), c(names)).alias("identification"), score_separation(c(names), c(expected)).alias("separation"),
        score_classification(c(creator), c(names), c(bodies)).alias("classification"), score_formatting(c(names)).alias("formatting"),
    )


def overall(scores: dict[str, Column]) -> tuple[Column, Column]:
    """(weighted score, verdict)."""
    total = sum((scores[k] * w for k, w in WEIGHTS.items()), F.lit(0.0))
    total = F.round(total, 6)
    return total, F.when(total >= 4.5, "correct").when(total >= 3.5, "partial").otherwise("incorrect")


def title_overlap(a: Column, b: Column) -> Column:
    """Share of the words of two titles that both have; 0 where one has none."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != ""))
    left, right = words(a), words(b)
    return F.when((F.size(left) > 0) & (F.size(right) > 0), jaccard(left, right)).otherwise(0.0)


def external_confidence(crossref: Column, orcid_hits: Column) -> tuple[Column, Column]:
    """(confidence, band) of look-ups: mean of the positive ones of title match and 0.7 x identifiers (five are full)."""
    orcid = 0.7 * F.least(F.lit(1.0), orcid_hits / 5)
    found = F.filter(F.array(F.coalesce(crossref, F.lit(0.0)), F.coalesce(orcid, F.lit(0.0))), lambda x: x > 0)
    mean = F.round(F.aggregate(found, F.lit(0.0), lambda acc, x: acc + x) / F.greatest(F.size(found), F.lit(1)), 6)
    return mean, F.when(mean > 0.7, "high").when(mean > 0.4, "medium").otherwise("low")


def spread(n: int) -> float:
    """Half-width of a 95 % interval of a share of one half; a guide for sample sizes (driver side)."""
    return 1.96 * math.sqrt(0.25 / n)
