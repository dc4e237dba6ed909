"""Rows that fail to parse: a quote-aware finite-state tokenizer over raw records.

The tokenizer is a table-driven automaton run over the bytes of a whole Arrow
batch at once. The buffer is cut into chunks of equal length; for each chunk
the *transition function* (end state for every possible start state) is
computed, all chunks in step; the functions are composed by a parallel prefix
scan, which gives every chunk its true start state however quoted cells cross
the chunk borders; a second pass then labels each byte with its state. A record
start resets the automaton, so that one bad record never spoils the next.

Two automata run on that engine: ``CSV`` (cells of a record) and
``LIST_LITERAL`` (a closed square-bracketed list of quoted strings).

Defined results: a null or empty record is one empty cell (``column_count``
unless one column is wanted); a null value is never wrong; texts of any length
are scanned whole; repeated rows come out as often as they went in; an empty
table gives an empty result; of the input only the named columns are read, so
that further columns, whatever they are called, do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 256


class Automaton:
    """Transition table over byte classes. State 0 is the start of a record."""

    def __init__(self, states: Sequence[str], classes: dict[str, str], moves: dict[tuple[str, str], str], error: str):
        self.names = list(states)
        index = {s: i for i, s in enumerate(states)}
        kinds = ["other", *classes]
        self.cls = np.zeros(256, np.uint8)
        for k, chars in enumerate(classes.values(), 1):
            self.cls[list(chars.encode())] = k
        self.kind = {k: i for i, k in enumerate(kinds)}
        self.n = len(states)
        self.table = np.full((len(kinds), self.n), index[error], np.uint8)
        for (state, kind), to in moves.items():
            for k in kinds if kind == "*" else [kind]:
                self.table[self.kind[k], index[state]] = index[to]
        self.flat = np.ascontiguousarray(self.table.reshape(-1))
        self.index = index

    def run(self, data: np.ndarray, starts: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
        """State after each byte of ``data``; ``starts`` are the offsets at which a record begins."""
        size = len(data)
        if not size:
            return np.zeros(0, np.uint8)
        n, rows = self.n, -(-size // chunk)
        cls = np.zeros(rows * chunk, np.int32)
        cls[:size] = self.cls[data]
        cls *= n
        cls = np.ascontiguousarray(cls.reshape(rows, chunk).T)
        fresh = np.zeros(rows * chunk, bool)
        fresh[starts[starts < size]] = True
        fresh = np.ascontiguousarray(fresh.reshape(rows, chunk).T)
        any_fresh = fresh.any(axis=1)
        move = np.tile(np.arange(n, dtype=np.uint8), (rows, 1))
        for j in range(chunk):
            if any_fresh[j]:
                move[fresh[j]] = 0
            move = self.flat[cls[j][:, None] + move]
        entry = self._prefix(move)
        out = np.empty((chunk, rows), np.uint8)
        state = entry
        for j in range(chunk):
            if any_fresh[j]:
                state = np.where(fresh[j], 0, state)
            state = self.flat[cls[j] + state]
            out[j] = state
        return out.T.reshape(-1)[:size]

    def _prefix(self, move: np.ndarray) -> np.ndarray:
        """Start state of each chunk: exclusive scan of function composition, log2(chunks) rounds."""
        done, step = move.copy(), 1
        while step < len(done):
            done[step:] = np.take_along_axis(done[step:], done[:-step], axis=1)
            step *= 2
        return np.concatenate([np.zeros(1, np.uint8), done[:-1, 0]])


CSV = Automaton(
    ["start", "plain", "quoted", "escaped", "closed", "broken"],
    {"comma": ",", "quote": '"', "backslash": "\\"},
    {
        ("start", "*"): "plain", ("start", "comma"): "start", ("start", "quote"): "quoted",
        ("plain", "*"): "plain", ("plain", "comma"): "start", ("plain", "quote"): "broken",
        ("quoted", "*"): "quoted", ("quoted", "quote"): "closed", ("quoted", "backslash"): "escaped",
        ("escaped", "*"): "quoted", ("escaped", "backslash"): "escaped",
        ("closed", "comma"): "start", ("closed", "quote"): "quoted",
    },
    "broken",
)

LIST_LITERAL = Automaton(
    ["before", "open", "single", "single_esc", "double", "double_esc", "after", "next", "shut", "broken"],
    {"blank": " \t\r\n", "open": "[", "close": "]", "comma": ",", "single": "'", "double": '"', "backslash": "\\"},
    {
        ("before", "blank"): "before", ("before", "open"): "open",
        ("open", "blank"): "open", ("open", "close"): "shut", ("open", "single"): "single", ("open", "double"): "double",
        ("single", "*"): "single", ("single", "single"): "after", ("single", "backslash"): "single_esc", ("single_esc", "*"): "single",
        ("double", "*"): "double", ("double", "double"): "after", ("double", "backslash"): "double_esc", ("double_esc", "*"): "double",
        ("after", "blank"): "after", ("after", "comma"): "next", ("after", "close"): "shut",
        ("next", "blank"): "next", ("next", "single"): "single", ("next", "double"): "double",
        ("shut", "blank"): "shut",
    },
    "broken",
)


def _bytes_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without copying, and the n + 1 offsets; null is empty."""
    values = pc.fill_null(values, "").cast(pa.large_string())
    offsets = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, values.offset * 8)
    base = int(offsets[0])
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[base : int(offsets[-1])]
    return data, offsets - base


def _last_states(automaton: Automaton, states: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ends = offsets[1:]
    full = ends > offsets[:-1]
    last = np.zeros(len(ends), np.uint8)
    last[full] = states[ends[full] - 1]
    return last


def list_literal_errors(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per value: is it anything but one closed list, and the byte offset at which that showed."""
    data, offsets = _bytes_of(values)
    states = LIST_LITERAL.run(data, offsets[:-1])
    last = _last_states(LIST_LITERAL, states, offsets)
    blank = pc.equal(pc.utf8_length(pc.utf8_trim_whitespace(pc.fill_null(values, ""))), 0).to_numpy(zero_copy_only=False)
    bad = (last != LIST_LITERAL.index["shut"]) & ~blank
    return bad, np.where(bad, _error_offset(states, LIST_LITERAL.index["broken"], offsets), -1)


def count_errors(values: pa.Array) -> np.ndarray:
    """Per value: is it, blanks trimmed, anything but empty or ASCII digits."""
    trimmed = pc.utf8_trim_whitespace(pc.fill_null(values, ""))
    return ~pc.match_substring_regex(trimmed, r"^[0-9]*$").to_numpy(zero_copy_only=False)


def _error_offset(states: np.ndarray, broken: int, offsets: np.ndarray) -> np.ndarray:
    """Offset of each record's first broken byte; its length where it just wasn't finished."""
    at = np.flatnonzero(states == broken)
    first = np.searchsorted(at, offsets[:-1])
    length = offsets[1:] - offsets[:-1]
    if not len(at):
        return length
    hit = at[np.minimum(first, len(at) - 1)]
    return np.where((first < len(at)) & (hit < offsets[1:]) & (hit >= offsets[:-1]), hit - offsets[:-1], length)


class Tokens:
    """Cells of a batch of records."""

    def __init__(self, records: pa.Array):
        self.data, self.offsets = _bytes_of(records)
        self.states = CSV.run(self.data, self.offsets[:-1])
        last = _last_states(CSV, self.states, self.offsets)
        bad = {CSV.index[s] for s in ("quoted", "escaped", "broken")}
        self.broken = np.isin(last, list(bad))
        cut = np.flatnonzero((self.data == ord(",")) & (self.states == CSV.index["start"]))
        self.cut = cut
        self.first = np.searchsorted(cut, self.offsets[:-1])
        self.count = np.searchsorted(cut, self.offsets[1:]) - self.first + 1
        self.error_at = _error_offset(self.states, CSV.index["broken"], self.offsets)

    def cell(self, rows: np.ndarray, k: int) -> pa.Array:
        """Cell ``k`` of the given well-formed records, its enclosing quotes and escapes resolved."""
        start = self.offsets[:-1][rows] if k == 0 else self.cut[self.first[rows] + k - 1] + 1
        last = k == self.count[rows] - 1
        nxt = self.first[rows] + k
        end = np.where(last, self.offsets[1:][rows], self.cut[np.minimum(nxt, max(len(self.cut) - 1, 0))] if len(self.cut) else 0)
        return self._text(start, end)

    def all_cells(self, rows: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """Every cell of the given records, flat, with the list offsets."""
        per = self.count[rows]
        ends_at = np.cumsum(per)
        owner = np.repeat(rows, per)
        k = np.arange(ends_at[-1] if len(per) else 0) - np.repeat(ends_at - per, per)
        prev = np.maximum(self.first[owner] + k - 1, 0)
        nxt = np.minimum(self.first[owner] + k, max(len(self.cut) - 1, 0))
        cut = self.cut if len(self.cut) else np.zeros(1, np.int64)
        start = np.where(k == 0, self.offsets[:-1][owner], cut[prev] + 1)
        end = np.where(k == self.count[owner] - 1, self.offsets[1:][owner], cut[nxt])
        end = np.where(self.broken[owner], start, end)
        return self._text(start, end), np.concatenate([[0], ends_at])

    def _text(self, start: np.ndarray, end: np.ndarray) -> pa.Array:
        quoted = np.zeros(len(start), bool)
        full = end > start
        quoted[full] = self.data[start[full]] == ord('"')
        start = start + quoted
        end = np.maximum(end - quoted, start)  # a lone quote of a broken record is no text
        size = end - start
        to = np.concatenate([[0], np.cumsum(size)])
        take = np.repeat(start - to[:-1], size) + np.arange(to[-1])
        data = self.data[take] if len(take) else np.zeros(0, np.uint8)
        text = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(to.astype(np.int64)), pa.py_buffer(data.tobytes()))
        if not quoted.any():
            return text.cast(pa.string())
        plain = pc.replace_substring_regex(text, r'""|\\"', '"')
        return pc.if_else(pa.array(quoted), plain, text).cast(pa.string())


def _single(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def parse_records(
    df: DataFrame,
    key: str,
    raw: str,
    columns: Sequence[str],
    counts: Sequence[str] = (),
    lists: Sequence[str] = (),
) -> DataFrame:
    """Each raw CSV record of ``df`` as one typed row, or as its reasons of failure.

    Output: ``key``; the ``columns`` as strings (null where the record could not
    be cut); ``reasons`` array<struct<reason, offset>>, empty for a good row.
    ``counts`` must be digits, ``lists`` closed lists of quoted strings. The
    reason ``quoting`` or ``column_count`` is a record's only one. The offset is
    in bytes: from the start of the record for ``quoting``, of the cell for a
    list, -1 where the whole is at fault. No shuffle: one pass per partition.
    """
    kind = df.schema[key].dataType.simpleString()
    fields = ", ".join(f"`{c}` string" for c in columns)
    schema = f"`{key}` {kind}, {fields}, reasons array<struct<reason: string, offset: bigint>>"
    out_type = pa.list_(pa.struct([("reason", pa.string()), ("offset", pa.int64())]))
    wanted = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = Tokens(_single(batch, raw))
            n = batch.num_rows
            fits = ~tokens.broken & (tokens.count == len(wanted))
            rows = np.flatnonzero(fits)
            back = np.full(n, -1, np.int64)
            back[rows] = np.arange(len(rows))
            take = pa.array(back, mask=back < 0)
            found: list[tuple[np.ndarray, str, np.ndarray]] = [
                (np.flatnonzero(tokens.broken), "quoting", tokens.error_at),
                (np.flatnonzero(~tokens.broken & ~fits), "column_count", np.full(n, -1)),
            ]
            cells = []
            for k, name in enumerate(wanted):
                cell = tokens.cell(rows, k)
                if name in counts:
                    found.append((rows[count_errors(cell)], name, np.full(n, -1)))
                if name in lists:
                    bad, at = list_literal_errors(cell)
                    spread = np.full(n, -1)
                    spread[rows] = at
                    found.append((rows[bad], name, spread))
                cells.append(cell.take(take))
            yield pa.RecordBatch.from_arrays(
                [_single(batch, key), *cells, _reasons(found, n, out_type)], names=[key, *wanted, "reasons"]
            )

    return df.select(key, raw).mapInArrow(run, schema)


def _reasons(found: list[tuple[np.ndarray, str, np.ndarray]], n: int, kind: pa.DataType) -> pa.Array:
    rows = np.concatenate([r for r, _, _ in found]) if found else np.zeros(0, np.int64)
    names = np.concatenate([np.full(len(r), i) for i, (r, _, _) in enumerate(found)]) if found else np.zeros(0, np.int64)
    at = np.concatenate([o[r] for r, _, o in found]) if found else np.zeros(0, np.int64)
    order = np.argsort(rows, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))])
    words = pa.array([name for _, name, _ in found] or [""]).take(pa.array(names[order]))
    items = pa.StructArray.from_arrays([words, pa.array(at[order].astype(np.int64))], names=["reason", "offset"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items).cast(kind)


def validate_fields(df: DataFrame, key: str, counts: Sequence[str] = (), lists: Sequence[str] = ()) -> DataFrame:
    """Already parted fields held against the same rules: ``key`` and ``reasons`` of every row."""
    kind = df.schema[key].dataType.simpleString()
    out_type = pa.list_(pa.struct([("reason", pa.string()), ("offset", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, found = batch.num_rows, []
            if not n:
                continue
            for name in counts:
                found.append((np.flatnonzero(count_errors(_single(batch, name))), name, np.full(n, -1)))
            for name in lists:
                bad, at = list_literal_errors(_single(batch, name))
                found.append((np.flatnonzero(bad), name, at))
            yield pa.RecordBatch.from_arrays([_single(batch, key), _reasons(found, n, out_type)], names=[key, "reasons"])

    return df.select(key, *counts, *lists).mapInArrow(run, f"`{key}` {kind}, reasons array<struct<reason: string, offset: bigint>>")


def split_cells(df: DataFrame, raw: str, out: str = "cells") -> DataFrame:
    """``df`` with the cells of each raw CSV record as an array; null where its quoting is broken."""
    names = df.columns
    schema = f"{df._jdf.schema().toDDL()}, `{out}` array<string>" if names else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = Tokens(_single(batch, raw))
            rows = np.arange(batch.num_rows)
            flat, offsets = tokens.all_cells(rows)
            cells = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
            cells = pc.if_else(pa.array(tokens.broken), pa.scalar(None, cells.type), cells)
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], names=[*names, out])

    return df.mapInArrow(run, schema)


def literal_items(cell: Column | str) -> Column:
    """The strings a list literal denotes; escapes resolved. A JVM expression."""
    cell = F.col(cell) if isinstance(cell, str) else cell
    spans = F.regexp_extract_all(cell, F.lit(r"""('(?:[^'\\]|\\.)*+'|"(?:[^"\\]|\\.)*+")"""), F.lit(1))
    return F.transform(spans, lambda s: unescape(F.substring(s, 2, F.length(s) - 2)))


def unescape(text: Column) -> Column:
    """Backslash escapes of a string literal. Only texts that hold a backslash pay for it."""
    plain = F.regexp_replace(text, r"\\x[aA]0", " ")
    plain = F.regexp_replace(F.regexp_replace(plain, r"\\n", "\n"), r"\\t", "\t")
    plain = F.regexp_replace(plain, r"""\\(['"\\])""", "$1")
    return F.when(F.contains(text, F.lit("\\")), plain).otherwise(text)


def rejected(parsed: DataFrame, key: str) -> DataFrame:
    """One row per reason of failure: ``key``, ``reason``, ``offset``."""
    return parsed.select(key, F.inline("reasons"))


def accepted(parsed: DataFrame, counts: Sequence[str] = (), lists: Sequence[str] = ()) -> DataFrame:
    """The good rows, counts as bigint and lists as arrays."""
    good = parsed.where(F.size("reasons") == 0).drop("reasons")
    typed = {c: F.expr(f"try_cast(trim(`{c}`) as bigint)") for c in counts}
    return good.withColumns(typed | {c: literal_items(c) for c in lists})
