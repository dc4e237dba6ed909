"""Language of each text and of each segment of a mixed text, with a confidence.

A sparse multinomial logistic regression on TF-IDF weighted character n-grams
(hashed, two to four characters), trained by follow-the-regularised-leader with
elastic-net penalties and calibrated by a temperature on held-out texts. Inverse
document frequencies are counted over all texts in Spark. The labelled texts the
classifier is fitted on are a bounded sample, by hash of their id: ``SAMPLE``
titles and as many opening sentences, and of each label at least ``PER_LABEL`` of
either, so that rare languages are in it. Since some labels are wrong, each half
is first judged by a model of the other half; rows that disagree are left out,
and so are languages most of whose texts are taken for another's (a label that
occurs by mistake only). What share of the table a language has doesn't matter.

A text is cut into sentences, each scored from prefix sums of its n-grams, and
the best path through the sentences, where a change of language costs
``SWITCH``, gives the segments. A segment's confidence is the calibrated
probability of its language given all its n-grams together; temperatures are
fitted by length on pieces of held-out texts, one error more than seen among them
being allowed for. Words in brackets and lists of keywords don't
make a segment. Garbled texts are read as repaired.

Defined results: null, empty and blank texts aren't rows; a text without letters
gets the language that is likeliest beforehand; texts of any length are scored
whole; rows that come twice come out twice; further columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colophon.llm import encoding_repair as er

BITS, ORDERS = 17, (2, 3, 4)
SAMPLE = 4000
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.02, 2
#: Rows sampled of each label besides; a language is told apart if at least so many of its texts, and half of them, are recognised by a model fitted on others.
PER_LABEL, LEAST_TEXTS, LEAST_AGREED = 200, 5, 0.5
#: Texts of a language rarer than this in the sample are learned from again, up to so many times.
BALANCE, MOST_TIMES = 100, 25
#: Upper bounds, in letters, of the lengths for which confidences are calibrated.
LENGTHS = (8, 16, 32, 96)
SWITCH, SHORT = 6.0, 20
SENTENCE = re.compile(r"(?<=[.!?…])[\"”»’)]*\s+|\s*\n+\s*|\s+—\s+")
BRACKETED = re.compile(r"\([^()]*\)|\[[^\[\]]*\]")
KEYWORDS = re.compile(r"^[^:.,]{1,24}:\s*(?:\S+(?:\s\S+){0,2},\s*)*\S+(?:\s\S+){0,2}$")
MOST_CODES = 10_000
NOT_LETTER = re.compile(r"[\W\d_]+")


def grams(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-grams of all texts in turn, number of n-grams of each)."""
    clean = [f" {NOT_LETTER.sub(' ', t.lower())} " for t in texts]
    parts, sizes = [], np.zeros(len(texts), np.int64)
    joined = "".join(clean)
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) for t in clean], np.int64)
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(texts)), lengths)
    left = ends[owner] - np.arange(len(cp)) if len(cp) else np.zeros(0, np.int64)
    h, keep, own = cp * np.uint32(0x9E3779B1), [], []
    for n in range(2, max(ORDERS) + 1):
        h = h[: len(cp) - n + 1] * np.uint32(31) + cp[n - 1 :] * np.uint32(0x85EBCA6B)
        if n in ORDERS:
            inside = left[: len(h)] >= n
            x = h[inside]
            keep.append(((x ^ (x >> np.uint32(15))) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS))
            own.append(owner[: len(h)][inside])
    parts, own_all = np.concatenate(keep), np.concatenate(own)
    order = np.argsort(own_all, kind="stable")
    sizes += np.bincount(own_all, minlength=len(texts))
    return parts[order], sizes


def document_frequency(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Texts that hold each n-gram, over all texts. At most 2^``BITS`` rows leave a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(1 << BITS, np.int64)
        n = 0
        for b in batches:
            texts = b["text"].tolist()
            for a in range(0, len(texts), 512):
                ids, sizes = grams(texts[a : a + 512])
                # each n-gram of each text once: one sort for many texts
                keys = np.sort(np.repeat(np.arange(len(sizes), dtype=np.int64), sizes) << BITS | ids)
                first = np.ones(len(keys), bool)
                first[1:] = keys[1:] != keys[:-1]
                df += np.bincount(keys[first] & ((1 << BITS) - 1), minlength=1 << BITS)
            n += len(b)
        hit = np.flatnonzero(df)
        yield pd.DataFrame({"gram": np.append(hit, -1), "n": np.append(df[hit], n)})

    rows = texts.select("text").mapInPandas(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << BITS)
    total = int(rows.loc[rows["gram"] == -1, "n"].sum())
    rows = rows[rows["gram"] >= 0]
    out[rows["gram"].to_numpy()] = rows["n"].to_numpy()
    return out, total


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


class Classifier:
    """Weights, inverse document frequencies and the temperature."""

    def __init__(self, idf: np.ndarray, classes: Sequence[str]):
        self.idf = idf.astype(np.float32)
        self.classes = list(classes)
        self.w = np.zeros((1 << BITS, len(self.classes)), np.float32)
        self.bias = np.zeros(len(self.classes), np.float32)
        self.temperature = 1.0
        self.by_length = np.ones(len(LENGTHS) + 1)

    def fit(self, texts: Sequence[str], labels: Sequence[int], seed: int = 7) -> Classifier:
        """FTRL-proximal, one text at a time."""
        k = len(self.classes)
        z, n = np.zeros((1 << BITS, k), np.float32), np.zeros((1 << BITS, k), np.float32)
        ids, sizes = grams(texts)
        spans = np.split(ids, np.cumsum(sizes)[:-1])
        feats = []
        for s in spans:
            u, c = np.unique(s, return_counts=True)
            v = c * self.idf[u]
            feats.append((u, (v / (np.linalg.norm(v) or 1.0)).astype(np.float32)))
        counts = np.bincount(labels, minlength=k) + 1.0
        self.bias = np.log(counts / counts.sum()).astype(np.float32)
        rng = np.random.default_rng(seed)
        for _ in range(EPOCHS):
            for i in rng.permutation(len(feats)):
                u, v = feats[i]
                w = self._weights(z[u], n[u])
                p = np.exp(_log_softmax(v @ w + self.bias))
                p[labels[i]] -= 1.0
                g = v[:, None] * p[None, :]
                g2 = g * g
                sigma = (np.sqrt(n[u] + g2) - np.sqrt(n[u])) / ALPHA
                z[u] += g - sigma * w
                n[u] += g2
        self.w = self._weights(z, n)
        return self

    @staticmethod
    def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)).astype(np.float32)

    def pack(self) -> Classifier:
        self.scored = self.w * self.idf[:, None]
        self.idf2 = self.idf**2
        return self

    def sums(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text the sums of its n-grams' scores and of their squared weights; both add up over the parts of a text."""
        out, norm = np.zeros((len(texts), len(self.classes))), np.zeros(len(texts))
        for a in range(0, len(texts), 512):
            ids, sizes = grams(texts[a : a + 512])
            full = np.flatnonzero(sizes)
            starts = (np.cumsum(sizes) - sizes)[full]
            if len(full):
                norm[a + full] = np.add.reduceat(self.idf2[ids], starts)
                out[a + full] = np.add.reduceat(self.scored[ids], starts, axis=0)
        return out, norm

    def joined(self, sums: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Logits: sums of n-gram scores over the length of the TF-IDF vector."""
        return sums / np.sqrt(np.maximum(norm, 1e-12))[..., None] + self.bias

    def logits(self, texts: Sequence[str]) -> np.ndarray:
        return self.joined(*self.sums(texts))

    def confidence(self, logits: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of texts of so many letters."""
        return np.exp(_log_softmax(logits / self.by_length[np.searchsorted(LENGTHS, letters)][..., None]))

    def log_proba(self, texts: Sequence[str]) -> np.ndarray:
        return _log_softmax(self.logits(texts) / self.temperature)

    def calibrate(self, texts: Sequence[str], labels: Sequence[int]) -> Classifier:
        """The temperature of the least cross-entropy on texts that weren't fitted on."""
        x, y = self.logits(texts), np.asarray(labels)
        loss = lambda t: -_log_softmax(x / t)[np.arange(len(y)), y].mean()
        self.temperature = float(min(np.geomspace(0.01, 3, 80), key=loss)) if len(y) else 1.0
        size, k = np.searchsorted(LENGTHS, letters(texts)), max(2, len(self.classes))
        for b in range(len(LENGTHS) + 1):
            own, mine = x[size == b], y[size == b]
            if len(own):
                # one error more than seen: no sample shows that there are none
                slip = 1 / (len(own) + 2)
                spread = np.full((len(own), k), slip / (k - 1))
                spread[np.arange(len(own)), mine] = 1 - slip
                spread = spread[:, : own.shape[1]]
                self.by_length[b] = min(np.geomspace(0.01, 10, 120), key=lambda t: -(spread * _log_softmax(own / t)).sum(axis=1).mean())
        return self


def letters(texts: Sequence[str]) -> np.ndarray:
    """Number of letters of each text."""
    return np.array([len(NOT_LETTER.sub("", t)) for t in texts], np.int64)


def reliability(model: Classifier, texts: Sequence[str], labels: Sequence[int], bins: int = 10) -> pd.DataFrame:
    """Per class of length: texts, accuracy, mean confidence, log-loss and expected calibration error."""
    size = letters(texts)
    p = model.confidence(model.logits(texts), size)
    top, sure, y = p.argmax(axis=1), p.max(axis=1), np.asarray(labels)
    rows = []
    for b, most in enumerate([*LENGTHS, None]):
        own = np.flatnonzero(np.searchsorted(LENGTHS, size) == b)
        if len(own):
            hit, conf = top[own] == y[own], sure[own]
            at = np.minimum((conf * bins).astype(int), bins - 1)
            error = sum(abs(hit[at == i].mean() - conf[at == i].mean()) * (at == i).mean() for i in range(bins) if (at == i).any())
            rows.append((most, len(own), hit.mean(), conf.mean(), -np.log(np.maximum(p[own, y[own]], 1e-12)).mean(), error))
    return pd.DataFrame(rows, columns=["most_letters", "n", "accuracy", "confidence", "log_loss", "calibration_error"])


def unaccented(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def named(label: Column, codes: DataFrame) -> Column:
    """The ``lang_code`` a label names in any spelling, or null. The table of codes is a small fixed list; one of more than ``MOST_CODES`` is refused."""
    rows = codes.limit(MOST_CODES + 1).collect()
    if len(rows) > MOST_CODES:
        raise ValueError(f"more than {MOST_CODES} language codes")
    names = {str(v).strip().lower(): r["lang_code"] for r in rows for v in (r["lang_name"], r["short_code"], r["lang_code"]) if v}
    text = F.lower(F.trim(F.regexp_replace(F.trim(label), "^__label__", "")))
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(pairs[text], pairs[F.element_at(F.split(text, "[_-]"), 1)])


def labelled(df: DataFrame, codes: DataFrame, size: int) -> pd.DataFrame:
    """Rows text, label: titles, and opening sentences whose two labels agree; of either at most ``size`` and ``PER_LABEL`` of each label."""
    df = df.select("id", "title", "abstract", *[named(F.col(c), codes).alias(c) for c in ("language", "pred_lang_title", "pred_lang_abstract")])
    by = F.xxhash64("id")
    titles = df.where("trim(title) != '' and pred_lang_title is not null").select(by.alias("h"), F.col("title").alias("text"), F.col("pred_lang_title").alias("label"))
    first = F.element_at(F.split("abstract", r"(?<=[.!?…])\s+|\n", 2), 1)
    opening = df.where("trim(abstract) != '' and language = pred_lang_abstract").select(by.alias("h"), first.alias("text"), F.col("language").alias("label"))
    first_of = Window.partitionBy("label").orderBy("h", "text")
    parts = []
    for x in (titles, opening):
        rare = x.withColumn("_r", F.row_number().over(first_of)).where(F.col("_r") <= PER_LABEL).drop("_r")
        parts.append(x.orderBy("h", "text").limit(size).unionByName(rare).distinct().toPandas())
    return pd.concat(parts, ignore_index=True)


def train(df: DataFrame, codes: DataFrame, texts: DataFrame, size: int = SAMPLE) -> Classifier:
    """The fitted and calibrated classifier."""
    counts, total = document_frequency(texts)
    idf = np.log((1 + total) / (1 + counts)) + 1.0
    return fit_labelled(labelled(df, codes, size), idf)[0]


def balanced(texts: Sequence[str], labels: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Texts of rare classes repeated, or the few of a rare language would never outweigh what is likelier beforehand."""
    counts = np.bincount(labels)
    times = np.clip(-(-BALANCE // np.maximum(counts, 1)), 1, MOST_TIMES)[labels]
    at = np.repeat(np.arange(len(labels)), times)
    return [texts[i] for i in at], labels[at]


def fit_labelled(rows: pd.DataFrame, idf: np.ndarray) -> tuple[Classifier, list[tuple[str, int]]]:
    """(classifier, held-out pieces with their classes) of rows ``h, text, label``, some of them labelled wrongly."""
    rows = rows.sort_values(["h", "text", "label"], ignore_index=True)
    classes = sorted(rows["label"].unique())
    y = np.array([classes.index(x) for x in rows["label"]], np.int64)
    x = rows["text"].tolist()
    if not len(x):
        return Classifier(idf, ["und"]).pack(), []
    half = np.arange(len(x)) % 2
    good = np.ones(len(x), bool)
    for h in (0, 1):
        seen, judged = np.flatnonzero(half != h), np.flatnonzero(half == h)
        if len(seen) and len(judged):
            m = Classifier(idf, classes).fit(*balanced([x[i] for i in seen], y[seen])).pack()
            good[judged] = m.logits([x[i] for i in judged]).argmax(axis=1) == y[judged]
    # a label most of whose texts are taken for another's language occurs by mistake
    agreed, all_ = np.bincount(y[good], minlength=len(classes)), np.bincount(y, minlength=len(classes))
    real = (agreed >= LEAST_TEXTS) & (agreed >= LEAST_AGREED * all_)
    good &= real[y]
    kept = np.flatnonzero(good) if good.any() else np.arange(len(x))
    if good.any():
        classes, y = [c for c, r in zip(classes, real, strict=True) if r], (np.cumsum(real) - 1)[y]
    held = kept[::5]
    fitted = np.setdiff1d(kept, held) if len(kept) > 20 else kept
    more = [t for i in fitted for t in (x[i], unaccented(x[i]))]
    model = Classifier(idf, classes).fit(*balanced(more, np.repeat(y[fitted], 2))).pack()
    # whole texts are too easy to tell how sure the model may be of short ones
    shorter = [(x[i][a : a + n], int(y[i])) for i in held for a, n in ((0, 400), (0, 24), (9, 12), (3, 8))]
    return model.calibrate([t for t, _ in shorter], [k for _, k in shorter]), shorter


def sentences(text: str) -> list[str]:
    return [s for s in SENTENCE.split(text) if s.strip()] or [text]


def path(scores: np.ndarray, cost: float = SWITCH) -> np.ndarray:
    """The best class of each sentence, a change costing ``cost``."""
    back = np.zeros(scores.shape, np.int64)
    best = scores[0].copy()
    for i in range(1, len(scores)):
        top = int(best.argmax())
        move = best[top] - cost > best
        back[i] = np.where(move, top, np.arange(len(best)))
        best = np.where(move, best[top] - cost, best) + scores[i]
    out = np.zeros(len(scores), np.int64)
    out[-1] = best.argmax()
    for i in range(len(scores) - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def segments(model: Classifier, texts: Sequence[str], whole: Sequence[bool]) -> list[list[tuple[str, str, float]]]:
    """Per text its segments (language, text, confidence). ``whole``: texts that are one segment."""
    cut = [[t] if w else sentences(t) for t, w in zip(texts, whole, strict=True)]
    bare = []
    for parts in cut:
        plain = [BRACKETED.sub(" ", p) for p in parts]
        listed = [bool(KEYWORDS.match(p.strip().rstrip("."))) for p in parts]
        bare += ["" if k and not all(listed) else (p if NOT_LETTER.sub("", p) else q) for p, q, k in zip(plain, parts, listed, strict=True)]
    sums, norm = model.sums(bare)
    scores = _log_softmax(model.joined(sums, norm) / model.temperature)
    size = letters(bare)
    scores = np.where((size > 0)[:, None], scores, 0.0) * np.minimum(1.0, size / SHORT)[:, None]
    out, at = [], 0
    for parts in cut:
        s = scores[at : at + len(parts)]
        way = path(s)
        marks = np.flatnonzero(np.diff(way)) + 1
        found = []
        for block in np.split(np.arange(len(parts)), marks):
            spot = at + block
            p = model.confidence(model.joined(sums[spot].sum(axis=0), norm[spot].sum()), size[spot].sum())
            found.append((model.classes[way[block[0]]], " ".join(parts[i] for i in block), float(p[way[block[0]]])))
        out.append(found)
        at += len(parts)
    return out


def _readable(repairer: er.Model, text: str) -> str:
    """The text as repaired; marks of lost characters, which aren't ends of sentences, left out."""
    if not er._odd(repairer, text):
        return text
    text = repairer.repair(text)[0]
    return re.sub("[?\ufffd]", "", text) if er.is_lost(text) else text


def label_texts(df: DataFrame, key: str, fields: Sequence[str], mixed: Sequence[str], codes: DataFrame) -> DataFrame:
    """``key, field_name, seg_no`` from 1, ``n_segs, lang_code, confidence, n_chars``; fields in ``mixed`` may have several segments."""
    texts = er.fields_of(df, key, fields).where("trim(text) != ''")
    repairer, _ = er.learn(texts)
    model = train(df, codes, texts)
    held = df.sparkSession.sparkContext.broadcast((model, repairer))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, r = held.value
        for b in batches:
            read = [_readable(r, t) for t in b["text"]]
            found = segments(m, read, [f not in mixed for f in b["field_name"]])
            rows = [
                (k, f, i, len(segs), lang, conf, len(text))
                for k, f, segs in zip(b[key], b["field_name"], found, strict=True)
                for i, (lang, text, conf) in enumerate(segs, 1)
            ]
            yield pd.DataFrame(rows, columns=[key, "field_name", "seg_no", "n_segs", "lang_code", "confidence", "n_chars"])

    return texts.mapInPandas(
        run, f"`{key}` {kind}, field_name string, seg_no int, n_segs int, lang_code string, confidence double, n_chars int"
    )
