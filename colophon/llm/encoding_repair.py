"""Garbled text from a wrong character encoding: find it, and restore it where it can be.

A text that was read with the wrong code page is a substitution cipher: every
byte, or every UTF-8 sequence of bytes, stands for one letter. Which code pages
were confused isn't known and differs by source, so for each pair of code pages
(a *cipher*) the mapping from garbled units to letters is learned by
expectation maximisation against the character bigrams of the whole table, and
applied with ``translate()``. The code pages are the prior of a mapping, no more:
units they leave open may stand for any letter, and the learned letter decides.
The confusions of ``READ_AS`` and ``SWAPS`` are tried on every suspicious text;
those of all other pairs of Python's code pages where the text stays unlikely.

1. Bigrams of characters are counted over all texts that hold no unit of a
   listed cipher and no word as no script writes it (aggregated in Spark).
2. Texts that hold a cipher's units, or whose likelihood falls far below the
   usual somewhere, are kept; they are a small part and are written once.
3. E-step in Spark: under the current mappings each text gets its most likely
   cipher (or none), each unit with its neighbours a distribution over letters.
   The expected counts are summed by (cipher, unit, letter) and by neighbouring
   characters, both bounded by the alphabets, and taken whole. M-step on the driver: new mappings, new cipher weights, new
   bigrams (the garbled ones taken out, the letters they stand for put in).
4. Each text is decoded, again and again as long as its likelihood rises, since
   some went through two confusions. Where the expectations leave a letter
   unsure, the code pages decide.

Texts in which characters were replaced ("�", "?" inside words) can't be
restored and come out as lost.

Defined results: null and empty texts aren't rows; a text with no unit of any
cipher is never changed; equally likely ciphers: the first of the list; whole
texts of any length are decoded; repeated rows come out as often as they went
in; further columns are not read.
"""

from __future__ import annotations

import codecs
import encodings
import hashlib
import pkgutil
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence
from functools import cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.session import spread, written

#: Code pages that UTF-8 was taken for, and pairs (written as, read as) of one-byte code pages.
READ_AS = ("cp1252", "cp1251", "cp1250", "mac_roman", "cp437", "cp850", "cp866", "koi8-r", "cp1254", "cp852", "iso8859-2")
SWAPS = (
    ("cp1251", "cp1252"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("koi8-r", "cp1252"),
    ("cp866", "cp1252"), ("iso8859-5", "cp1252"), ("mac_cyrillic", "cp1251"), ("cp1251", "mac_cyrillic"), ("cp1251", "cp437"),
    ("cp1251", "cp850"), ("cp1251", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp850", "cp1252"), ("cp437", "cp1252"),
    ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp1252", "cp1250"), ("cp1252", "cp1251"),
)
#: Bound of the bigram table: characters told apart, the most frequent ones of the whole table; all others count as one.
LM_CHARS = 2000
OTHER = chr(0x10FFFF)
LETTERS = 160  # non-ASCII letters a unit may stand for: the most frequent ones
ROUNDS, GAIN, SWAP_GAIN, PASSES = 3, 4.0, 12.0, 4
#: Weight of the code pages' letter among the expected counts; least share of a learned letter that is sure.
BOOK, SURE = 1.0, 0.6
#: Log of the number of characters that the bigrams don't tell apart.
RARE_CHAR = 9.4
#: A text is looked at if 24 characters are this much less likely each than usual, or one is as rare as this.
STRETCH, RARE = 2.5, -9.5


def code_page(name: str) -> list[str]:
    """Character of each byte; bytes the page leaves undefined stay as control characters."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


NOT_ASCII = re.compile(r"[^\x00-\x7f]")


class Cipher:
    """One confusion of code pages: how its units look, and what they are by the book."""

    def __init__(self, written_as: str, read_as: str):
        self.name = f"{written_as}>{read_as}"
        page = code_page(read_as)
        self.to_byte = {c: b for b, c in enumerate(page) if b >= 128}
        self.page = page
        self.wide = written_as == "utf-8"
        if read_as == "cp1252":  # and Latin-1, which shows the same bytes as control characters
            self.to_byte |= {chr(b): b for b in range(128, 160)}
        if self.wide:
            part = lambda a, z: "[" + "".join(re.escape(c) for c, b in self.to_byte.items() if a <= b <= z) + "]"
            tail = part(0x80, 0xBF)
            self.pattern = re.compile(f"{part(0xF0, 0xF4)}{tail}{{3}}|{part(0xE0, 0xEF)}{tail}{{2}}|{part(0xC2, 0xDF)}{tail}")
        else:
            other = code_page(written_as)
            self.book = {c: other[b] for c, b in self.to_byte.items() if other[b] != c}
            self.pattern = re.compile("[" + "".join(map(re.escape, self.book)) + "]")
        #: What the mapping reads: UTF-8 sequences, or any character but ASCII.
        self.units = self.pattern if self.wide else NOT_ASCII

    def by_the_book(self, unit: str) -> str | None:
        if not self.wide:
            return self.book.get(unit)
        try:
            return bytes(self.to_byte[c] for c in unit).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            return None


CIPHERS = [Cipher("utf-8", p) for p in READ_AS] + [Cipher(a, b) for a, b in SWAPS]


@cache
def cipher_of(name: str) -> Cipher:
    listed = {c.name: c for c in CIPHERS}
    return listed.get(name) or Cipher(*name.split(">"))


@cache
def code_pages() -> dict[str, str]:
    """Upper half of each of Python's one-byte code pages that agree with ASCII; of equal ones the first."""
    out: dict[str, str] = {}
    for module in sorted(m.name for m in pkgutil.iter_modules(encodings.__path__)):
        if "decoding_table" not in Path(encodings.__path__[0], f"{module}.py").read_text("utf-8"):
            continue
        name = codecs.lookup(module).name
        page = "".join(code_page(name))
        if page[:128] == "".join(map(chr, range(128))) and page[128:] not in out.values():
            out[name] = page[128:]
    return out


@cache
def other_wide() -> list[Cipher]:
    """UTF-8 taken for any code page that ``READ_AS`` doesn't hold."""
    listed = {codecs.lookup(p).name for p in READ_AS}
    return [cipher_of(f"utf-8>{p}") for p in code_pages() if p not in listed]


@cache
def all_swaps() -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(code points of all code pages, which of them each becomes if a pair's confusion is undone, names of the pairs)."""
    pages = code_pages()
    symbols = "".join(sorted({c for p in pages.values() for c in p if ord(c) > 127}))
    at = {c: i for i, c in enumerate(symbols)}
    half = {n: np.array([at.get(c, -1) for c in p]) for n, p in pages.items()}
    rows, pairs = [], []
    for read_as, seen in half.items():
        byte = np.full(len(symbols), -1)
        byte[seen[seen >= 0]] = np.flatnonzero(seen >= 0)
        for written_as, meant in half.items():
            if written_as != read_as:
                new = np.where(byte >= 0, meant[byte], -1)
                rows.append(np.where(new >= 0, new, np.arange(len(symbols))).astype(np.int16))
                pairs.append(f"{written_as}>{read_as}")
    return np.array([ord(c) for c in symbols]), np.array(rows), pairs


@cache
def listed_swaps() -> set[str]:
    return {f"{codecs.lookup(a).name}>{codecs.lookup(b).name}" for a, b in SWAPS}


def plausible(letter: str | None) -> bool:
    """A letter or mark of the scripts the code pages are for, and no control character.

    Sequences of other scripts can't be told from words: in good texts letters
    follow each other as the bytes of such a character do on some page. They are
    looked at where a text is unlikely.
    """
    if letter is None:
        return False
    c = ord(letter[0])
    return 0xA0 <= c <= 0x17F or 0x400 <= c <= 0x45F or 0x2010 <= c <= 0x203A or c in (0x20AC, 0x2122)


BEYOND_ASCII = re.compile(r"[^\x00-\x7f]+")


def stretches(text: str) -> str:
    """All runs of characters beyond ASCII, each with the character before and after it."""
    out = []
    for m in BEYOND_ASCII.finditer(text):
        a, b = m.span()
        out.append(f"{text[a - 1] if a else ' '}{m.group()}{text[b] if b < len(text) else ' '}")
    return "\n".join(out)


#: A unit lies within one of these.
RUN = re.compile(r"[^\x00-\x7f]{2,}")


def has_units(text: str) -> bool:
    """Holds a UTF-8 sequence, read with any of the code pages, of a plausible letter."""
    runs = "\n".join(set(RUN.findall(text)))
    return bool(runs) and any(plausible(c.by_the_book(m.group())) for c in CIPHERS if c.wide for m in c.pattern.finditer(runs))


#: Words as no script writes them: signs or box drawings inside, or capitals after small letters beyond ASCII.
#: Texts that hold one don't teach the bigrams, or a confusion that is frequent would look usual.
ODD_WORD = re.compile(r"[^\W\d_][^\x00-\x7f\w\s’‘·–—…«»“”\xad]+[^\W\d_]|[^\W\d_][²³¹¼½¾][^\W\d_]|[\u2500-\u259f]|[а-яёà-öø-ÿ][А-ЯЁÀ-ÖØ-Þ]")


LOST_MARK = re.compile(r"(?<=[^\W\d_])\?(?=[^\W\d_])|(?<=[\s'’(])\?+(?=\w)|\?(?=\w)|(?<=\w)\?(?=[,;:])|\?\?+\s*\w|(?<=\s)\?\s+\w|(?<=\w)\?(?=\s+[^\W\d_A-ZА-Я])")
LOST_UPPER = re.compile(r"(?<=\w)\?(?=\s+\w)")


def is_lost(text: str) -> bool:
    """Were characters replaced for good."""
    if "�" in text:
        return True
    if "?" not in text:
        return False
    body = text.rstrip("?*. \n\t")
    return bool(LOST_MARK.search(body) or (body.upper() == body and LOST_UPPER.search(body)))


class Bigrams:
    """log P(next | previous) over at most ``LM_CHARS`` characters, add-one smoothed."""

    def __init__(self, counts: dict[tuple[int, int], float]):
        one: Counter = Counter()
        for (a, b), n in counts.items():
            one[a] += n / 2
            one[b] += n / 2
        one.pop(ord(OTHER), None)
        chars = sorted(c for c, _ in one.most_common(LM_CHARS))
        self.index = np.full(0x110000, len(chars), np.int16)
        self.index[chars] = np.arange(len(chars))
        size = len(chars) + 1
        table = np.full((size, size), 0.02)
        if counts:
            pairs = np.array(list(counts), np.int64)
            np.add.at(table, (self.index[pairs[:, 0]], self.index[pairs[:, 1]]), np.maximum(np.array(list(counts.values())), 0))
        self.log = np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)
        self.letters = [chr(c) for c, _ in one.most_common() if c > 127 and chr(c).isprintable()][:LETTERS]

    def codes(self, text: str) -> np.ndarray:
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.index[cp]

    def steps(self, text: str) -> np.ndarray:
        c = self.codes(f" {text} ")
        return self.log[c[:-1], c[1:]]


def count_bigrams(texts: DataFrame) -> dict[tuple[int, int], float]:
    """Bigrams of all texts without units; summed in each batch, then in Spark. At most (``LM_CHARS`` + 1)² rows reach the driver, whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            joined = " " + "\n ".join(t for t in b["text"] if t.isascii() or not ("�" in t or ODD_WORD.search(t) or has_units(t))) + " "
            cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            pair, n = np.unique(cp[:-1] << 32 | cp[1:], return_counts=True)
            yield pd.DataFrame({"a": (pair >> 32).astype(np.int32), "b": (pair & 0xFFFFFFFF).astype(np.int32), "n": n})

    by_pair = texts.select("text").mapInPandas(run, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
    pairs = written(by_pair)
    chars = pairs.select(F.explode(F.array("a", "b")).alias("c"), "n").groupBy("c").agg(F.sum("n").alias("n"))
    kept = [r["c"] for r in chars.orderBy(F.desc("n"), "c").limit(LM_CHARS).collect()]
    told = F.broadcast(texts.sparkSession.createDataFrame([(c,) for c in kept], "c int"))
    for side in ("a", "b"):
        pairs = pairs.join(told.select(F.col("c").alias(side), F.lit(True).alias("_k")), side, "left")
        pairs = pairs.withColumn(side, F.when(F.col("_k"), F.col(side)).otherwise(ord(OTHER))).drop("_k")
    rows = pairs.groupBy("a", "b").agg(F.sum("n").alias("n")).toPandas().sort_values(["a", "b"])
    return {(int(a), int(b)): float(n) for a, b, n in zip(rows["a"], rows["b"], rows["n"], strict=True)}


class Model:
    """Mappings of all ciphers, their weights, and the bigrams."""

    def __init__(self, counts: dict[tuple[int, int], float]):
        self.counts = counts
        self.lm = Bigrams(counts)
        self.learned: dict[str, dict[str, dict[str, float]]] = {c.name: {} for c in CIPHERS}
        self.weight = {c.name: 1.0 for c in CIPHERS}
        self.top: dict[tuple[str, str], str | None] = {}
        pairs = np.array(list(counts), np.int64).reshape(-1, 2)
        n = np.array(list(counts.values()))
        logs = self.lm.log[self.lm.index[pairs[:, 0]], self.lm.index[pairs[:, 1]]]
        self.usual = float((logs * n).sum() / n.sum()) if len(n) else 0.0

    def letters_of(self, cipher: Cipher, unit: str) -> dict[str, float]:
        """Letters a unit may stand for: as learned, else by the book with a little doubt, else any."""
        known = self.learned.get(cipher.name, {}).get(unit)
        if known:
            return known
        book = cipher.by_the_book(unit)
        others = self.lm.letters
        if book is None and unit not in cipher.to_byte and not cipher.wide:
            book = unit  # no character of the page, most likely not garbled
        if book is not None and (cipher.wide or book.isprintable()):
            return {book: 0.95} | {x: 0.05 / len(others) for x in others if x != book}
        return {x: 1 / len(others) for x in others}

    def best_letter(self, cipher: Cipher, unit: str) -> str | None:
        """The letter by the learned mapping; the code pages' where that is unsure."""
        key = (cipher.name, unit)
        if key not in self.top:
            self.top[key] = self._best_letter(cipher, unit)
        return self.top[key]

    def _best_letter(self, cipher: Cipher, unit: str) -> str | None:
        book = cipher.by_the_book(unit)
        known = self.learned.get(cipher.name, {}).get(unit)
        if not known:  # no text has taught a letter
            return book if book is not None or cipher.wide or unit in cipher.to_byte else unit
        top = max(known, key=lambda x: (known[x], x))
        return top if known[top] > SURE else book

    def decode(self, cipher: Cipher, text: str) -> str:
        """Units folded to one character each, then one ``translate()``."""
        table: dict[int, str] = {}
        if not cipher.wide:
            for c in set(cipher.units.findall(text)):
                table[ord(c)] = self.best_letter(cipher, c) or c
            return text.translate(table)
        code: dict[str, str] = {}

        def fold(m: re.Match) -> str:
            unit = m.group()
            if unit not in code:
                letter = self.best_letter(cipher, unit)
                if letter is None:
                    return unit
                code[unit] = chr(0xF0000 + len(code))
                table[ord(code[unit])] = letter
            return code[unit]

        return cipher.pattern.sub(fold, text).translate(table)

    def likeliest(self, text: str) -> tuple[Cipher, str] | None:
        """The cipher, and the text decoded by it, of the greatest gain in log likelihood, if that is enough.

        Gains are reckoned on the stretches beyond ASCII and their neighbours, as
        no cipher changes anything else. A mostly ASCII text in which whole UTF-8
        sequences decode into something much likelier isn't tried for one-byte
        confusions.
        """
        part = stretches(text)
        if not part:
            return None
        old = float(self.lm.steps(part).sum())
        latin = 2 * len(text.encode("ascii", "ignore")) > len(text) * 1.2
        best, gain = None, 0.0
        for c in CIPHERS:
            if c.wide and c.pattern.search(part):
                new = self.decode(c, part)
                if new != part:
                    g = float(self.lm.steps(new).sum()) - old + float(np.log(self.weight[c.name]))
                    if g > GAIN and (best is None or g > gain):
                        best, gain = c, g
        if best is None or not latin or gain <= SWAP_GAIN:
            chars, codes = np.unique(np.frombuffer(f" {part} ".encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
            step, n = np.unique(codes[:-1].astype(np.int64) * len(chars) + codes[1:], return_counts=True)
            a, b = step // len(chars), step % len(chars)
            letters = [chr(c) for c in chars]
            here = self.lm.index[chars]
            before = float(self.lm.log[here[a], here[b]] @ n.astype(np.float32))
            for c in CIPHERS:
                if not c.wide and c.pattern.search(part):
                    there = self.lm.index[[ord((self.best_letter(c, x) or x)[0]) if x > "\x7f" else ord(x) for x in letters]]
                    g = float(self.lm.log[there[a], there[b]] @ n.astype(np.float32)) - before + float(np.log(self.weight[c.name]))
                    if g > SWAP_GAIN and (best is None or g > gain):
                        best, gain = c, g
        if best is None:
            return None
        new = self.decode(best, text)
        return (best, new) if new != text else None

    def unlikely(self, text: str) -> bool:
        """Has a stretch much less likely than usual, or one step that is very rare."""
        steps = np.cumsum(self.steps(text))
        w = min(len(steps) - 1, 24)
        if w < 2:
            return not text.isascii()
        return float((steps[w:] - steps[:-w]).min() / w) < self.usual - STRETCH or float(np.diff(steps).min()) < RARE

    def screened(self, text: str) -> list[Cipher]:
        """The one-byte confusion, of all pairs of code pages, that by the book gains most; all equal ones but the first are left out."""
        points, rows, pairs = all_swaps()
        chars, codes = np.unique(np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
        spot = np.minimum(np.searchsorted(points, chars), len(points) - 1)
        held = np.flatnonzero(points[spot] == chars)
        if not len(held):
            return []
        new = rows[:, spot[held]]
        key = new.astype(np.int64) @ np.random.default_rng(1).integers(1, 1 << 40, len(held))
        first = np.sort(np.unique(key, return_index=True)[1])
        index = self.lm.index
        table = np.tile(index[chars], (len(first), 1))
        table[:, held] = index[points][new[first]]
        step, n = np.unique(codes[:-1].astype(np.int64) * len(chars) + codes[1:], return_counts=True)
        a, b = step // len(chars), step % len(chars)
        changed = np.isin(a, held) | np.isin(b, held)
        a, b, n = a[changed], b[changed], n[changed]
        best = int(first[np.argmax(self.lm.log[table[:, a], table[:, b]] @ n.astype(np.float32))])
        return [] if pairs[best] in listed_swaps() or (new[best] == spot[held]).all() else [cipher_of(pairs[best])]

    def chain(self, text: str) -> list[tuple[Cipher, str]]:
        """(listed cipher undone, text then), until none makes the text likelier."""
        done = []
        for _ in range(PASSES):
            best = self.likeliest(text)
            if best is None:
                break
            done.append(best)
            text = best[1]
        return done

    def steps(self, text: str) -> np.ndarray:
        """As those of the bigrams, with the characters that count as one told apart."""
        c = self.lm.codes(f" {text} ")
        return self.lm.log[c[:-1], c[1:]] - RARE_CHAR * (c[1:] == len(self.lm.log) - 1)

    def likelihood(self, text: str) -> float:
        return float(self.steps(text).sum())

    def undone(self, text: str) -> list[tuple[Cipher, str]]:
        """(cipher undone, text then). If the listed ciphers leave a text unlikely, all others are
        tried before and after them; as these are many, they must gain more."""
        done = self.chain(text)
        end = done[-1][1] if done else text
        if not self.unlikely(end):
            return done
        best, least = done, self.likelihood(end)
        for start, before in [(text, []), (end, done)][: 1 + bool(done)]:
            for c in [*(c for c in other_wide() if c.pattern.search(start)), *self.screened(start)]:
                new = self.decode(c, start)
                if new != start:
                    many = GAIN + np.log(len(other_wide())) if c.wide else SWAP_GAIN + np.log(len(all_swaps()[2]))
                    steps = [*before, (c, new), *self.chain(new)]
                    value = self.likelihood(steps[-1][1]) + float(np.log(self.weight.get(c.name, 1.0)) - many)
                    if value > least:
                        best, least = steps, value
        return best

    def first(self, text: str) -> list[tuple[Cipher, str]]:
        """The first step of ``undone``, if any."""
        best = self.likeliest(text)
        return [best] if best and not self.unlikely(best[1]) else self.undone(text)[:1]

    def repair(self, text: str) -> tuple[str, str]:
        """(restored text, ciphers undone)."""
        done = self.undone(text)
        return (done[-1][1] if done else text), " ".join(c.name for c, _ in done)

    def contexts(self, cipher: Cipher, text: str, new: str) -> Iterator[tuple[str, str, str, str]]:
        """(cipher, left, unit, right) of a text's units; the neighbours as decoded in ``new``."""
        shift = 0
        for m in cipher.units.finditer(text):
            unit, spot = m.group(), m.start() + shift
            shift += (1 - len(unit)) if self.best_letter(cipher, unit) else 0
            yield cipher.name, new[spot - 1] if spot > 0 else " ", unit, new[spot + 1] if spot + 1 < len(new) else " "

    def shares(self, cipher: Cipher, left: str, unit: str, right: str) -> Iterator[tuple[str, float]]:
        """The letters a unit between two neighbours stands for, with their probabilities."""
        options = self.letters_of(cipher, unit)
        if not options:
            return
        names = list(options)
        codes = self.lm.codes("".join(n[0] for n in names))
        logit = np.log(np.array(list(options.values()))) + self.lm.log[self.lm.codes(left)[0], codes] + self.lm.log[codes, self.lm.codes(right)[0]]
        share = np.exp(logit - logit.max())
        for n, s in zip(names, share / share.sum(), strict=True):
            if s > 0.02:
                yield n, float(s)

    def improve(self, rows: pd.DataFrame) -> None:
        """M-step from the expectations: columns cipher, left, unit, right, letter, n."""
        self.improve_summed(pd.DataFrame(summed_shares(rows.itertuples(index=False, name=None)), columns=SUMS))

    def improve_summed(self, rows: pd.DataFrame) -> None:
        """M-step from sums by cipher, unit and letter; under no cipher, by two neighbouring characters."""
        if rows.empty:
            return
        pairs, rows = rows[rows["cipher"] == ""], rows[rows["cipher"] != ""]
        totals = rows.groupby("cipher")["n"].sum()
        whole = float(totals.sum()) or 1.0
        names = list(dict.fromkeys([*(c.name for c in CIPHERS), *totals.index]))
        self.weight = {c: (1 + float(totals.get(c, 0))) / (whole + len(names)) * len(names) for c in names}
        self.weight = {k: min(max(v, 0.2), 5.0) for k, v in self.weight.items()}
        by = rows.groupby(["cipher", "unit", "letter"])["n"].sum()
        table: dict[str, dict[str, dict[str, float]]] = {c: defaultdict(dict) for c in names}
        for (name, unit, letter), n in by.items():
            table[name][unit][letter] = float(n)
        for name, units in table.items():
            for unit, letters in units.items():
                book = cipher_of(name).by_the_book(unit)
                if book is not None and (cipher_of(name).wide or book.isprintable()):
                    letters[book] = letters.get(book, 0) + BOOK
                total = sum(letters.values())
                self.learned.setdefault(name, {})[unit] = {k: v / total for k, v in letters.items() if v / total > 1e-3}
        for a, b, n in zip(pairs["unit"], pairs["letter"], pairs["n"], strict=True):
            key = (ord(a), ord(b))
            self.counts[key] = self.counts.get(key, 0.0) + n
        self.lm = Bigrams(self.counts)
        self.top = {}


SUMS = ["cipher", "unit", "letter", "n"]


def summed_shares(rows: Iterable[tuple[str, str, str, str, str, float]]) -> list[tuple[str, str, str, float]]:
    """Rows of ``SUMS`` of (cipher, left, unit, right, letter, n)."""
    sums: Counter = Counter()
    for cipher, left, unit, right, letter, n in rows:
        sums[cipher, unit, letter] += n
        sums["", left, letter[0]] += n
        sums["", letter[-1], right] += n
    return [(*k, n) for k, n in sums.items()]


def _odd(model: Model, text: str) -> bool:
    """Worth a closer look: units of a cipher, replaced characters, or an unlikely stretch."""
    if text.isascii():
        return "?" in text and is_lost(text)
    if "�" in text or is_lost(text) or has_units(text):
        return True
    return model.unlikely(text)


def fields_of(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """``key``, ``field_name``, ``text`` of every non-empty field."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in fields])
    rows = spread(df.select(*dict.fromkeys((key, *fields))))
    return rows.select(key, F.explode(pairs).alias("f")).select(key, "f.*").where("text != ''")


def learn(texts: DataFrame, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """(model, suspicious texts): expectation maximisation over the whole table."""
    spark = texts.sparkSession
    model = Model(count_bigrams(texts))
    held = spark.sparkContext.broadcast(model)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[_odd(held.value, t) for t in b["text"]]]

    odd = written(texts.mapInPandas(keep, texts.schema))
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(model)

        def expect(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            m = now.value
            for b in batches:
                seen: Counter = Counter()
                for text in b["text"]:
                    for cipher, new in m.first(text):
                        seen.update(m.contexts(cipher, text, new))
                rows = (
                    (name, left, unit, right, letter, n * share)
                    for (name, left, unit, right), n in seen.items()
                    for letter, share in m.shares(cipher_of(name), left, unit, right)
                )
                yield pd.DataFrame(summed_shares(rows), columns=SUMS)

        sums = odd.mapInPandas(expect, "cipher string, unit string, letter string, n double")
        sums = sums.groupBy(*SUMS[:3]).agg(F.sum("n").alias("n"))
        model.improve_summed(sums.orderBy(*SUMS[:3]).toPandas())
    return model, odd


def repair(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """``key, field_name, text, repaired, ciphers, lost, text_md5`` of every garbled field.

    ``repaired`` is null and ``text_md5`` empty where characters are lost for good.
    """
    texts = fields_of(df, key, fields)
    model, odd = learn(texts)
    held = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, f, text in zip(b[key], b["field_name"], b["text"], strict=True):
                lost = is_lost(text)
                new, ciphers = ("", "") if lost else held.value.repair(text)
                lost = lost or (bool(ciphers) and is_lost(new))
                if lost or new != text:
                    md5 = "" if lost else hashlib.md5(new.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((k, f, text, None if lost else new, ciphers, lost, md5))
            yield pd.DataFrame(out, columns=[key, "field_name", "text", "repaired", "ciphers", "lost", "text_md5"])

    return odd.mapInPandas(
        run, f"`{key}` {kind}, field_name string, text string, repaired string, ciphers string, lost boolean, text_md5 string"
    )
