"""Mapping freely typed names to the entries of a reference list.

1. Values are deduplicated: one row per distinct value, counted with map-side
   combining, so each is matched once however often it was typed.
2. Each is normalised and given candidates by an inverted index of character
   n-grams (ordered, unordered and skipping one, so that swapped letters share
   most of theirs), scored by weighted cosine and accepted if the score is above
   a threshold and no other entry's is within a margin of it. Of entries within
   the margin, the one of the fewest edits is taken, if there is just one.
3. An exact check follows: no more letters may differ than fit the length of
   the name (``fair_edits``), since a name of another place can share nearly all
   n-grams with a listed one.
4. The entries are joined back to the rows. Values that hold at least a
   thousandth of all rows (fewer than a thousand by construction) are broadcast;
   all others are joined by shuffle, where no key has more than that.

A name has two blocks of features, each of unit length. The *kind* block holds
the words that say what sort of thing it is: those that are frequent in the list
itself (in at least the square root of its entries, if nearly all hold others besides) and those of ``KINDS``, an
optional parameter, which brings words and abbreviations of several languages to
one form. The *place* block holds the n-grams, weighted by inverse document
frequency, of all other words. A list without frequent words (cities, brands)
has places only. Words that resemble no word of the list count as kinds of their
own: a "Ministry of Culture of Northmere" shares its place with a university but
is another body.

The list goes to the workers in shards of at most ``MAX_ENTRIES`` entries, by
hash of the id; every name is held against all shards, and threshold, margin and
edits apply to the rivals of all of them, so a list of any length is matched
whole (n-gram weights are those of each shard). Defined results: null and empty
names are no rows of the result; unmatched names, and names without a letter or
digit, get entry 0; entries that are written alike fail the margin; names of any
length are scored whole; names in ideographs match only letter by letter;
further columns are kept out; an empty list gives 0 for all.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.session import written

MAX_ENTRIES = 200_000
#: Words for kinds of bodies: form in the features -> words and abbreviations, without accents.
KINDS: dict[str, str] = {
    "UNIV": "university universitat universitaet universidad universite universidade universitas universita univ uni unv u",
    "STATE": "state st negeri",
    "INST": "institute instituto institut inst",
    "TECH": "technology tecnologico technol tech tec techn tecn technische technical tecnol technological",
    "POLI": "politecnico politec polytechnic polit poli",
    "AUT": "autonoma aut autonomous auton",
    "FED": "federal fed",
    "COLL": "college coll col",
    "ARTS": "arts art seni",
    "LETT": "letters lett",
    "HS": "hochschule hs hochsch",
    "MEDIA": "medien media",
    "ACAD": "accademia academy acad acc",
    "ECOLE": "ecole school",
    "JOUR": "journalisme journalism journ",
    "ETUD": "etudes etud studies",
}
#: Abbreviations of several words.
PHRASES = {"tu": "technische universitat", "un": "universitas negeri"}
STOP = frozenset("of de di d des du del della the and e y fur for la le les el los do da das dos a an in degli studi".split())
#: Parts that name a unit of a body, not another body.
UNITS = re.compile(
    r"\s*\([^()]*\)|\s+[-–—]\s+(?:dept|department|faculty|school|centre|center|institute for|lab)\b.*$"
    r"|^(?:dept|department|faculty|school|centre|center|div|division|section|chair)\b[^,@]*(?:,|@)\s*",
    re.I,
)
#: Part of the score that the place has; least cosine of the kind, of both; least distance to the next entry.
PLACE_SHARE, LEAST_KIND, THRESHOLD, MARGIN = 0.5, 0.93, 0.72, 0.03
#: A word of at least this many entries, and of the square root of all, is a kind.
LEAST_FREQUENT = 3
#: Frequent words are kinds only if so many entries hold others besides.
MOST_PLACED = 0.9
IDEOGRAPH = re.compile("[\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff]")
HOT_SHARE = 1000
#: Words whose reading a worker keeps.
KEPT = 200_000


def plain(text: str) -> str:
    """Lower case without accents; only letters and digits, single blanks."""
    text = unicodedata.normalize("NFKD", text.lower().replace("ß", "ss").replace("ø", "o").replace("æ", "ae"))
    text = "".join(ch for ch in text if not unicodedata.combining(ch))
    return re.sub(r"[\W_]+", " ", text).strip()


def grams(words: Sequence[str]) -> Counter:
    """Character n-grams of each word with its borders: two letters in order and in any, three in any, two around a third."""
    out: Counter = Counter()
    for w in words:
        w = f"^{w}$"
        for i in range(len(w) - 1):
            out[w[i : i + 2]] += 1
            out["~" + "".join(sorted(w[i : i + 2]))] += 1
        for i in range(len(w) - 2):
            out[f"-{w[i]}{w[i + 2]}"] += 1
            out["=" + "".join(sorted(w[i : i + 3]))] += 1
    return out


def fair_edits(text: str) -> int:
    """How many letters of a name may be written otherwise: none of four or of ideographs, one of seven, two of fifteen, ..."""
    n = len(text)
    return 0 if n < 5 or IDEOGRAPH.search(text) else 1 + n // 8


def edits(a: str, b: str, most: int) -> int:
    """Edit distance, a swap of neighbours counting once; ``most`` + 1 if it is larger than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [0] * (len(b) + 1), list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def shortened(word: str) -> set[str]:
    """The word and all that it is with one letter left out: words one edit apart share one of these."""
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


class Matcher:
    """Entries of a reference list as an inverted index. Built once on the driver, shipped to the workers."""

    def __init__(self, entries: Sequence[tuple[int, str]], kinds: Mapping[str, str] = KINDS):
        n = len(entries)
        if n > MAX_ENTRIES:
            raise ValueError(f"{n} entries in one shard; the bound is {MAX_ENTRIES}")
        self.kinds = {w: k for k, words in kinds.items() for w in words.split()}
        written_words = [set(plain(name).split()) - STOP for _, name in entries]
        frequent = Counter(w for words in written_words for w in words)
        frequent = {w: w for w, c in frequent.items() if c >= max(LEAST_FREQUENT, math.sqrt(n))}
        if sum(bool(words - frequent.keys() - self.kinds.keys()) for words in written_words) >= MOST_PLACED * n:
            self.kinds = frequent | self.kinds
        self.long_kinds = [w for w in self.kinds if len(w) >= 9]
        self.short_kinds: dict[str, list[str]] = defaultdict(list)
        for w in self.kinds:
            for v in shortened(w) if len(w) >= 4 else ():
                self.short_kinds[v].append(w)
        self.ids = np.array([i for i, _ in entries], np.int64)
        self.words: set[str] = set()
        self.known: dict[str, str | None] = {}
        self.fair: dict[str, bool] = {}
        split = [self._split(name, learn=True) for _, name in entries]
        self.by_gram: dict[str, list[str]] = defaultdict(list)
        self.by_short: dict[str, list[str]] = defaultdict(list)
        for w in sorted(self.words):
            for g in set(grams([w])):
                self.by_gram[g].append(w)
            for v in shortened(w):
                self.by_short[v].append(w)
        self.places = [" ".join(place) for _, place in split]
        self.exact: dict[tuple, list[int]] = defaultdict(list)
        for (i, _), (kind, place) in zip(entries, split, strict=True):
            self.exact[frozenset(kind), " ".join(place)].append(int(i))
        df_kind = Counter(k for kind, _ in split for k in set(kind))
        df_gram = Counter(g for _, place in split for g in grams(place))
        self.idf_kind = {k: 0.5 + math.log((1 + n) / (1 + c)) for k, c in df_kind.items()}
        self.idf_gram = {g: math.log((1 + n) / (1 + c)) + 0.3 for g, c in df_gram.items()}
        self.other = math.log(1 + n) + 0.5
        self.no_kind = np.array([not kind for kind, _ in split], bool)
        self.no_place = np.array([not place for _, place in split], bool)
        self.kind_post, self.place_post = defaultdict(list), defaultdict(list)
        for i, (kind, place) in enumerate(split):
            for k, w in self._unit({x: self.idf_kind[x] for x in set(kind)}).items():
                self.kind_post[k].append((i, w))
            for g, w in self._unit({g: c * self.idf_gram[g] for g, c in grams(place).items()}).items():
                self.place_post[g].append((i, w))
        pack = lambda post: {k: (np.array([i for i, _ in v]), np.array([w for _, w in v])) for k, v in post.items()}
        self.kind_post, self.place_post = pack(self.kind_post), pack(self.place_post)

    @staticmethod
    def _unit(v: dict[str, float]) -> dict[str, float]:
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {k: x / norm for k, x in v.items()}

    def _kind(self, word: str) -> str | None:
        """The kind a word stands for, written rightly or nearly so."""
        if word not in self.known:
            kind = self.kinds.get(word)
            if kind is None and len(word) >= 4 and word not in self.words and not IDEOGRAPH.search(word):
                hits = {self.kinds[w] for v in shortened(word) for w in self.short_kinds.get(v, ()) if edits(word, w, 1) <= 1}
                if not hits:
                    hits = {self.kinds[w] for w in self.long_kinds if edits(word, w, 2) <= 2}
                kind = hits.pop() if len(hits) == 1 else None
            self.known[word] = kind
        return self.known[word]

    def _split(self, name: str, learn: bool = False) -> tuple[list[str], list[str]]:
        """(kinds, words of the place). Words like none of the list are kinds of their own."""
        cut = UNITS.sub("", name) if not learn else name
        words = [x for w in (plain(cut) or plain(name)).split() if w not in STOP for x in PHRASES.get(w, w).split()]
        if len(self.known) + len(self.fair) > KEPT:
            self.known.clear()
            self.fair.clear()
        kind, place = [], []
        for w in words:
            k = self.kinds.get(w) if learn else self._kind(w)
            if k:
                kind.append(k)
            elif learn or w in self.words or (len(w) > 2 and self._is_near(w)):
                place.append(w)
            elif self._slip(w):
                continue
            elif self._resembles(w):
                place.append(w)
            else:
                kind.append(f"?{w}")
        if learn:
            self.words.update(place)
        return kind, place

    def _is_near(self, word: str) -> bool:
        """One edit away from a word of the list."""
        if IDEOGRAPH.search(word):
            return False
        return any(edits(word, w, 1) <= 1 for v in shortened(word) for w in self.by_short.get(v, ()))

    @staticmethod
    def _slip(word: str) -> bool:
        """A mistyped article or preposition."""
        return len(word) <= 2 or (len(word) <= 4 and any(edits(word, w, 1) <= 1 for w in STOP if len(w) >= 2))

    def _resembles(self, word: str) -> bool:
        """Shares a fair part of its n-grams with a word of the list."""
        if word not in self.fair:
            mine = set(grams([word]))
            hits = Counter(w for g in mine for w in self.by_gram.get(g, ()))
            self.fair[word] = any(c / math.sqrt(len(mine) * (4 * len(w) + 2)) >= 0.45 for w, c in hits.items())
        return self.fair[word]

    def match(self, name: str) -> int:
        """The entry's id, or 0."""
        return decide(self.rivals(name))

    def rivals(self, name: str) -> list[tuple[float, int, int]]:
        """(score, edits too many are -1, id) of the best entry and of all within the margin of it, if it is above the threshold."""
        kind, place = self._split(name)
        if not kind and not place:
            return []
        same = self.exact.get((frozenset(kind), " ".join(place)))
        if same:  # cosine 1
            return [(1.0, 0, i) for i in same]
        return self._score(set(kind), place)

    def _score(self, kind: set[str], place: list[str]) -> list[tuple[float, int, int]]:
        n = len(self.ids)
        if not n:
            return []
        of = lambda vec, post: [(post[k], x) for k, x in vec.items() if k in post]

        def cosine(parts: list) -> np.ndarray:
            if not parts:
                return np.zeros(n)
            at = np.concatenate([p[0] for p, _ in parts])
            return np.bincount(at, np.concatenate([p[1] * x for p, x in parts]), minlength=n)

        # what neither side has is the same
        places = cosine(of(self._unit({g: c * self.idf_gram.get(g, self.other) for g, c in grams(place).items()}), self.place_post)) if place else self.no_place * 1.0
        kinds = cosine(of(self._unit({k: self.idf_kind.get(k, self.other) for k in kind}), self.kind_post)) if kind else self.no_kind * 1.0
        score = PLACE_SHARE * places + (1 - PLACE_SHARE) * kinds
        score[kinds < LEAST_KIND] = 0
        top = float(score.max())
        if top < THRESHOLD:
            return []
        text = " ".join(place)
        most = fair_edits(text)
        out = []
        for i in np.flatnonzero(score > top - MARGIN):
            e = edits(text, self.places[i], most)
            out.append((float(score[i]), e if e <= most else -1, int(self.ids[i])))
        return out


def decide(rivals: Sequence[tuple[float, int, int]]) -> int:
    """The entry above the threshold whose score no other comes near; of near ones that of the fewest edits; 0 if there are several, or too many edits."""
    if not rivals:
        return 0
    top = max(r[0] for r in rivals)
    near = sorted((r[1], r[2]) for r in rivals if r[0] > top - MARGIN and r[1] >= 0)
    return 0 if not near or (len(near) > 1 and near[1][0] == near[0][0]) else near[0][1]


def reference(listed: DataFrame, entry_id: str, name: str, most: int = MAX_ENTRIES) -> list[DataFrame]:
    """The list in shards of about ``most`` entries or fewer, each to be collected on its own."""
    rows = listed.select(F.col(entry_id).cast("bigint").alias("id"), F.col(name).alias("name")).dropna()
    shards = -(-rows.count() * 5 // (most * 4)) or 1  # a hash fills no shard by a quarter more than the mean
    return [rows.where(F.pmod(F.xxhash64("id"), F.lit(shards)) == i) for i in range(shards)] if shards > 1 else [rows]


def matcher(shard: DataFrame) -> Matcher:
    return Matcher(sorted((int(r[0]), r[1]) for r in shard.collect()))


def match_values(values: DataFrame, name: str, shards: Sequence[DataFrame], keep: Sequence[str] = (), out: str = "entry_id") -> DataFrame:
    """``name``, ``keep`` and the entry's id (0: none) of each distinct value."""
    spark, kinds = values.sparkSession, dict(values.dtypes)
    schema = ", ".join([f"`{name}` string", *[f"`{k}` {kinds[k]}" for k in keep]])
    parts = None
    for shard in shards:
        held = spark.sparkContext.broadcast(matcher(shard))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            m = held.value
            for b in batches:
                found = [[{"s": s, "e": e, "i": i} for s, e, i in m.rivals(v)] for v in b.column(0).to_pylist()]
                kind = pa.list_(pa.struct([("s", pa.float64()), ("e", pa.int32()), ("i", pa.int64())]))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], names=[name, *keep, "_rivals"])

        part = values.select(name, *keep).mapInArrow(run, f"{schema}, _rivals array<struct<s: double, e: int, i: bigint>>")
        parts = part if parts is None else parts.unionByName(part)
    if len(shards) > 1:
        parts = parts.groupBy(name, *keep).agg(F.flatten(F.collect_list("_rivals")).alias("_rivals"))
    # as ``decide``
    top = F.array_max(F.transform("_rivals", lambda r: r["s"]))
    near = F.array_sort(F.transform(F.filter("_rivals", lambda r: (r["s"] > F.col("_top") - MARGIN) & (r["e"] >= 0)), lambda r: F.struct(r["e"], r["i"])))
    first, second = F.get("_near", F.lit(0)), F.get("_near", F.lit(1))
    clear = first.isNotNull() & (second.isNull() | (second["e"] > first["e"]))
    return parts.withColumn("_top", top).withColumn("_near", near).select(name, *keep, F.when(clear, first["i"]).otherwise(F.lit(0)).cast("bigint").alias(out))


def map_names(df: DataFrame, keep: Sequence[str], name: str, shards: Sequence[DataFrame], out: str = "entry_id") -> DataFrame:
    """``keep``, ``name`` and the entry's id (0: none) for every row with a name. The rows are kept in the shared folder, as they are read twice."""
    rows = written(df.select(*keep, name).where(f"trim(`{name}`) != ''"))
    counts = rows.groupBy(name).agg(F.count("*").alias("_n"))
    mapped = written(match_values(counts, name, shards, ("_n",), out))
    hot_from = F.lit(max(2, rows.count() // HOT_SHARE))
    hot = mapped.where(F.col("_n") >= hot_from).select(name, out)
    rest = mapped.where(F.col("_n") < hot_from).select(name, out)
    # one pass: the few hot values are looked up at once, only rows of other values are shuffled
    seen = rows.join(F.broadcast(hot), name, "left")
    known = seen.where(F.col(out).isNotNull()).select(*keep, name, out)
    return known.unionByName(seen.where(F.col(out).isNull()).drop(out).join(rest, name).select(*keep, name, out))
