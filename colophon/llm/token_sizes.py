"""Sizes of texts in tokens of a public byte-level BPE vocabulary, counted exactly.

A pre-token of this family begins at a blank at the latest, so a text without
two blanks in a row has as many tokens as its blank-parted pieces have, each
with the blank before it. The pieces' counts are kept in the worker, which makes
counting a matter of splitting and looking up. Texts with double blanks are
encoded whole. Null texts have size 0; texts of any length are counted whole.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.session import spread

#: Place of the vocabulary (ranks) and how a text is cut before merging.
VOCABULARY = os.environ.get("COLOPHON_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEPT = 500_000


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(f"ranks of {path}", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Counts(dict):
    """Piece -> number of tokens."""

    def __init__(self, path: str):
        super().__init__()
        self.encode = encoding(path).encode_ordinary

    def __missing__(self, piece: str) -> int:
        n = len(self.encode(piece))
        if len(self) >= KEPT:
            self.clear()
        self[piece] = n
        return n

    def of(self, text: str) -> int:
        if not text:
            return 0
        if "  " in text:
            return len(self.encode(text))
        first, *rest = text.split(" ")
        # most pieces are known without their blank put before them again
        return self.get_first(first) + sum(map(self.after_blank.__getitem__, rest))

    def get_first(self, piece: str) -> int:
        return self[piece] if piece else 0

    @property
    def after_blank(self) -> AfterBlank:
        if "_after" not in self.__dict__:
            self._after = AfterBlank(self)
        return self._after


class AfterBlank(dict):
    """Piece -> number of tokens with a blank before it."""

    def __init__(self, counts: Counts):
        super().__init__()
        self.counts = counts

    def __missing__(self, piece: str) -> int:
        n = len(self.counts.encode(" " + piece))
        if len(self) >= KEPT:
            self.clear()
        self[piece] = n
        return n


def token_sizes(df: DataFrame, text: str, path: str = VOCABULARY, out: str = "n_tokens", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns and the number of tokens of ``text``, which doesn't leave the worker."""
    rows = spread(df.select(*keep, F.col(text).alias("_text")))
    schema = f"{df.select(*keep)._jdf.schema().toDDL()}, `{out}` bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(path)
        for b in batches:
            sizes = pa.array([counts.of(t) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], sizes], names=[*keep, out])

    return rows.mapInArrow(run, schema)
