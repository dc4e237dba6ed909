"""Personal names: counting, canonical form, simple cases."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

AUTHOR_BREAK = r"(?iU)\s*(?:;|&|\band\b|\+|/|\\)\s*"
TITLES = frozenset("dr prof mr mrs ms miss sir dame rev hon lord lady".split())
SUFFIXES = frozenset("jr sr ii iii iv phd md esq".split())
PREFIXES = frozenset("de da di do dos das del della der den van von la le du des el al bin ibn ter ten zu".split())
#: What looks like an affiliation or contact rather than a name.
AFFILIATION = r"(?i)\b(universit|faculty|department|institute|hospital|school|center|college|email|@|www\.|http|orcid|tel|phone|doi:)"


def author_count(c: Column) -> Column:
    """Non-blank parts between ``; & + / \\`` and the word "and"; blank gives 0."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), AUTHOR_BREAK), lambda v: F.trim(v) != ""))


def is_simple(c: Column) -> Column:
    """No affiliation, one person by the look of the separators."""
    return (
        ~c.rlike(AFFILIATION)
        & ~c.rlike(r"(?i)[;&/\\]| and ")
        & (F.regexp_count(c, F.lit(r",[ ]*\p{Lu}")) <= 1)
    )


def parse_name(text: str) -> tuple[str, str, str]:
    """(first, middle, last) of a western name; titles and suffixes are left out, particles belong to the last name."""
    if "," in text:
        last, _, rest = text.partition(",")
        words = [w for w in rest.split() if w.strip(".").lower() not in TITLES | SUFFIXES]
        return (words[0] if words else "", " ".join(words[1:]), last.strip())
    words = [w for w in text.split() if w.strip(".,").lower() not in SUFFIXES]
    while words and words[0].strip(".").lower() in TITLES:
        words = words[1:]
    if len(words) < 2:
        return (words[0] if words else "", "", "")
    cut = len(words) - 1
    while cut > 1 and words[cut - 1].lower() in PREFIXES:
        cut -= 1
    return words[0], " ".join(words[1:cut]), " ".join(words[cut:])


def canonical(text: str) -> str:
    """First and last name in lower case without accents."""
    first, _, last = parse_name(text)
    both = unicodedata.normalize("NFD", f"{first} {last}".strip())
    return re.sub(r"\s+", " ", "".join(c for c in both if not unicodedata.combining(c))).lower()


def last_first(text: str) -> str:
    """``Last, First Middle``; a name with a comma only gets its blanks in order."""
    text = re.sub(r"\s+", " ", text or "").strip()
    if "," in text:
        left, _, right = text.partition(",")
        return f"{left.strip()}, {right.strip()}" if right.strip() else left.strip()
    first, middle, last = parse_name(text)
    caps = lambda s: " ".join(w.capitalize() for w in s.split())
    given = caps(f"{first} {middle}".strip())
    return f"{caps(last)}, {given}" if last and given else caps(last) or given or text


def canonical_field(text: str | None) -> str:
    """Every name of a field in canonical form, joined by comma and blank."""
    parts = (canonical(p.strip()) for p in re.split(r",\s+", text or "") if p.strip())
    return ", ".join(p for p in parts if p)


def canonical_names(c: Column) -> Column:
    """``canonical_field`` of each value, in Arrow batches; null gives the empty text."""
    return F.pandas_udf(lambda v: v.map(canonical_field), "string")(c)


def person_last_first(c: Column) -> Column:
    return F.pandas_udf(lambda v: v.map(last_first), "string")(c)
