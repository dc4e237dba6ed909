"""The analysis table of publications: one projection, one join per derived key, a fixed order of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.functions import identifiers as fi
from colophon.functions import measures as fm
from colophon.functions import texts as ft
from colophon.operators import matching as om

KEPT = ("research_org_country_names", "research_org_types", "open_access", "document_type", "type", "concepts", "language", "publisher")


def analysis_table(works: DataFrame, key: str, journals: DataFrame, best_rank: DataFrame, first_author) -> DataFrame:
    """All variables of a work. ``best_rank``: ``key, best_rank``; ``first_author``: column of the first author's id."""
    tokens = fi.issn_tokens(F.col("issn"), hyphen_aware=True)
    disciplinary = om.covered_by_any(works, key, [(tokens, journals, tokens)]).withColumnRenamed("covered", "disciplinary")
    one = works.select(
        key, fm.invisibility(F.col("times_cited")).alias("invisibility"), fm.invisible(F.col("times_cited")).alias("invisible"),
        ft.number(F.col("times_cited")).alias("times_cited"), ft.paper_year(F.col("year"), F.col("date")).alias("paper_year"),
        first_author.alias("first_author"), fi.doi_normal(F.col("doi")).alias("doi"), *[c for c in KEPT if c in works.columns],
    )
    first = one.where("first_author is not null").groupBy("first_author").agg(F.min("paper_year").alias("_first"))
    full = one.join(first, "first_author", "left").join(best_rank, key, "left").join(disciplinary, key, "left")
    order = [key, "doi", "paper_year", "times_cited", "invisibility", "invisible", "disciplinary", "best_rank", "prestige", "first_author", "experience"]
    full = full.withColumns({"experience": F.col("paper_year") - F.col("_first"), "prestige": fm.prestige(F.col("best_rank"))})
    return full.select(*order, *[c for c in KEPT if c in works.columns])
