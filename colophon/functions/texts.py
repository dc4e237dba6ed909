"""Titles, names of bodies, dates, literals. Column expressions unless said otherwise."""

from __future__ import annotations

import html
import re
import unicodedata
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    """A double if the text is one number and nothing else, else null (``12d``, ``NaN`` and ``0x1F`` are none)."""
    return F.when(F.trim(c).rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"), F.trim(c)).try_cast("double")


def title_key(c: Column) -> Column:
    """Lower case, letters and digits only; nothing left is null."""
    bare = F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}]", "")
    return F.when(bare != "", bare)


def title_key_punct(c: Column) -> Column:
    """Lower case without ASCII punctuation and blanks; other symbols stay."""
    return F.regexp_replace(F.lower(c), r"[\p{Punct}\s]", "")


def body_key(c: Column) -> Column:
    """Institution names: dashes and quotes as blanks, ASCII letters, digits and ``&`` kept."""
    text = F.regexp_replace(F.lower(c), "[-‐‑‒–—'’‘`\"“”]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^a-z0-9&\s]", " "), r"\s+", " "))


def name_list(c: Column) -> Column:
    """Names of a cell: brackets and quotes as blanks, parted at ``; , / |`` or two blanks."""
    text = F.regexp_replace(c, r"""[\[\]"']""", " ")
    return F.filter(F.transform(F.split(text, r"[;,/|]|\s{2,}"), lambda v: F.trim(v)), lambda v: v != "")


def first_year(c: Column) -> Column:
    return F.regexp_extract(c, r"([0-9]{4})", 1).try_cast("int")


def paper_year(year: Column, date: Column) -> Column:
    """The numeric year, else the first four digits of the date."""
    return F.coalesce(number(year).try_cast("int"), first_year(date))


def year_of_file(name: Column) -> Column:
    """The last 19xx or 20xx of a file name."""
    found = F.regexp_extract_all(name, F.lit(r"((?:19|20)[0-9]{2})"), F.lit(1))
    return F.try_element_at(found, F.lit(-1)).try_cast("int")


def as_json(c: Column) -> Column:
    """A Python literal as JSON text: None, True and False renamed outside quotes; JSON stays as it is."""
    names = F.regexp_replace(c, r"(?<=[\[\s:,])None(?=[\s,\]}])", "null")
    names = F.regexp_replace(names, r"(?<=[\[\s:,])True(?=[\s,\]}])", "true")
    return F.regexp_replace(names, r"(?<=[\[\s:,])False(?=[\s,\]}])", "false")


def struct_list(c: Column, fields: str) -> Column:
    """``array<struct<fields>>`` of JSON or Python-literal text, else null."""
    text = F.when(F.lower(F.trim(c)).isin("", "none", "nan", "null"), None).otherwise(c)
    return F.from_json(as_json(text), f"array<struct<{fields}>>", {"allowSingleQuotes": "true", "mode": "PERMISSIVE"})


def quoted_ids(c: Column, pattern: str) -> Column:
    """Values of ``'id': '...'`` that match a pattern, in order."""
    return F.regexp_extract_all(c, F.lit(rf"'id':\s*'({pattern})'"), F.lit(1))


def concept_list(c: Column) -> Column:
    """Brackets and single quotes stripped, parted at comma and blank."""
    return F.split(F.translate(c, "[]'", ""), ", ")


def category_code(c: Column) -> Column:
    return F.regexp_extract(c, r"^([0-9]+)", 1).try_cast("int")


def category_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"^[0-9]+", ""))


def search_text(c: Column, most: int = 100) -> Column:
    """Tags dropped, blanks squeezed, cut to ``most`` characters with an ellipsis."""
    text = F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), "[\\s\u00a0]+", " "))
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def snake_name(name: str) -> str:
    """A column name in snake case (driver side)."""
    text = unicodedata.normalize("NFKD", name)
    text = "".join(c for c in text if not unicodedata.combining(c))
    text = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", text)
    return re.sub(r"[^a-z0-9]+", "_", text.lower()).strip("_")


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


def plain_text(markup: str | None) -> str:
    """Text of HTML, in NFKC, blanks squeezed."""
    if not markup:
        return ""
    reader = _Text()
    reader.feed(markup)
    reader.close()
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", html.unescape(" ".join(reader.parts)))).strip()


def rough_clean(c: Column) -> Column:
    """``plain_text`` of each value, in Arrow batches; null gives the empty text."""
    return F.pandas_udf(lambda v: v.map(plain_text), "string")(c)
