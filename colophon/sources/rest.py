"""Paged web interfaces as Spark data sources.

A *fetcher* (a picklable callable of parameters, giving a decoded page) is
passed in, so that tests and other transports need no network; the default
reads JSON over HTTPS. Counts are reconciled, repeated cursors refused, and
temporary failures tried again from the page that failed, so no record comes
twice.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RETRIED = (429, 502, 503, 504)
Fetch = Callable[[str, dict], dict]


class TemporaryError(Exception):
    """A failure that may pass."""


def fetch_json(url: str, params: dict, timeout: float = 60.0) -> dict:
    try:
        with urllib.request.urlopen(f"{url}?{urllib.parse.urlencode(params)}", timeout=timeout) as r:
            return json.load(r)
    except urllib.error.HTTPError as e:
        if e.code in RETRIED:
            raise TemporaryError(str(e)) from e
        raise
    except urllib.error.URLError as e:
        raise TemporaryError(str(e)) from e


@dataclass
class Retry:
    """Tries with growing pauses; the page gets smaller with each of ``sizes``."""

    sizes: Sequence[int] = (200, 150, 100)
    tries: int = 5
    base: float = 1.5
    sleep: Callable[[float], None] = time.sleep

    def page(self, fetch: Fetch, url: str, params: dict, size_name: str) -> dict:
        for size in self.sizes:
            for n in range(self.tries):
                try:
                    return fetch(url, {**params, size_name: size})
                except TemporaryError:
                    self.sleep(self.base**n)
        raise TemporaryError(f"{url}: given up")


def cursor_pages(fetch: Fetch, url: str, params: dict, retry: Retry | None = None, delay: float = 0.0, strict: bool = True) -> Iterator[dict]:
    """Results of a cursor-paged listing. ``strict``: fewer or more than announced is an error, else only a note."""
    retry, cursor, seen, n, announced = retry or Retry(), "*", set(), 0, None
    while cursor:
        if cursor in seen:
            raise ValueError(f"{url}: the cursor came again")
        seen.add(cursor)
        page = retry.page(fetch, url, {**params, "cursor": cursor}, "per-page")
        meta, results = page.get("meta", {}), page.get("results", [])
        announced = meta.get("count", announced)
        yield from results
        n += len(results)
        cursor = meta.get("next_cursor") if results else None
        if cursor and delay:
            time.sleep(delay)
    if strict and announced is not None and announced != n:
        raise ValueError(f"{url}: {n} records, {announced} announced")


def directory_pages(fetch: Fetch, url: str, page_size: int = 1000, done: dict[int, list] | None = None, keep: Callable[[int, list], None] | None = None) -> Iterator[dict]:
    """A whole directory by offset. Pages already ``done`` aren't fetched again; ``keep`` is told each new one."""
    offset, total, last = 0, None, None
    while total is None or offset < total:
        page = offset // page_size
        if done and page in done:
            items, total = done[page], total if total is not None else done.get(-1, [None])[0]
        else:
            message = fetch(url, {"rows": page_size, "offset": offset})["message"]
            items = message["items"]
            if total is not None and message["total-results"] != total:
                raise ValueError(f"{url}: the total changed while reading")
            total = message["total-results"]
            if keep:
                keep(-1, [total])
                keep(page, items)
        if items and items == last:
            raise ValueError(f"{url}: a page came again")
        if not items:
            raise ValueError(f"{url}: an empty page before the end")
        last = items
        offset += len(items)
        if offset > total:
            raise ValueError(f"{url}: more records than announced")
        yield from items


def lookup(fetch: Fetch, url: str, params: dict) -> dict | None:
    """One record, or None if there is none."""
    try:
        return fetch(url, params)
    except urllib.error.HTTPError as e:
        if e.code == 404:
            return None
        raise


@dataclass
class Slice(InputPartition):
    params: dict


class PagedSource(DataSource):
    """``spark.read.format("colophon_pages")``: options ``url``, ``slices`` (JSON list of parameter objects, one task each).

    Rows are (slice, record as JSON). Register with ``spark.dataSource.register``.
    """

    fetch: Fetch = staticmethod(fetch_json)

    @classmethod
    def name(cls) -> str:
        return "colophon_pages"

    def schema(self) -> str:
        return "slice string, record string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options["url"], json.loads(self.options.get("slices", "[{}]")), type(self).fetch)


class PagedReader(DataSourceReader):
    def __init__(self, url: str, slices: list[dict], fetch: Fetch):
        self.url, self.slices, self.fetch = url, slices, fetch

    def partitions(self) -> Sequence[InputPartition]:
        return [Slice(s) for s in self.slices]

    def read(self, partition: Slice) -> Iterator[tuple]:
        for record in cursor_pages(self.fetch, self.url, partition.params):
            yield json.dumps(partition.params, sort_keys=True), json.dumps(record, ensure_ascii=False)


def key_batches(keys: Sequence[str], size: int = 100) -> list[str]:
    """Keys joined by bars, at most ``size`` to a request."""
    return ["|".join(keys[i : i + size]) for i in range(0, len(keys), size)]
