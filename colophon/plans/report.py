"""A validation report as CSV, JSON and a plain HTML page."""

from __future__ import annotations

import html
from pathlib import Path

from pyspark.sql import DataFrame

MOST_ROWS = 1000


def html_table(df: DataFrame, title: str, most: int = MOST_ROWS) -> str:
    """The first rows of a summary as an HTML table; a report, so limited on purpose."""
    cell = lambda v: html.escape("" if v is None else str(v))
    rows = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in df.limit(most).collect())
    head = "".join(f"<th>{cell(c)}</th>" for c in df.columns)
    return f"<h2>{cell(title)}</h2><table><thead><tr>{head}</tr></thead><tbody>{rows}</tbody></table>"


def write_report(parts: dict[str, DataFrame], folder: str) -> str:
    """Each part whole as CSV and JSON lines, the first rows of all as one page; gives the page's path."""
    base = Path(folder)
    base.mkdir(parents=True, exist_ok=True)
    for name, df in parts.items():
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(str(base / f"{name}.csv"))
        df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(str(base / f"{name}.json"))
    page = "".join(html_table(df, name) for name, df in parts.items())
    (base / "report.html").write_text(f"<!doctype html><meta charset='utf-8'><title>Validation</title>{page}", encoding="utf-8")
    return str(base / "report.html")
