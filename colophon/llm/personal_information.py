"""Personal information inside free text, found by bootstrapped contextual extraction.

1. One pass over the whole texts yields *candidates*: e-mail addresses (also
   disguised), number groups of seven digits or more, capitalised sequences that
   may be a name, and number-and-street phrases that may be an address; each with
   the words before and after it.
2. Every candidate is an edge between a *pattern* (kind and neighbouring words)
   and *instances* (the number's shape, the tokens of the name, the street).
   Seeds are certain: what has the form of an e-mail address is one, numbers with
   an international prefix are phone numbers, numbers after a label of ``ID_LABELS`` identify persons, names spelled out in
   an e-mail address are names, streets with a postcode are streets.
3. Spark scores the graph in turn: a pattern by the share of its edges that lead
   to known instances, an instance by its best patterns. After ``ROUNDS`` rounds
   confident patterns have brought in unseen instances, and these further
   patterns.
4. Candidates are accepted by the scores of both ends; names inside the name of a
   prize or body are left out. ``mask`` puts typed placeholders into the text.

The edges are summed before any shuffle. Where they, or the candidates, meet the
scores of patterns and instances, those that hold a thousandth of all rows are
broadcast and all others merged by shuffle: a pattern that a third of all
candidates share is in no one task, and nothing that grows is broadcast.

Defined results: null and empty texts have no rows; texts are scanned whole;
where candidates overlap the one with the best score counts, then the
longest; repeated documents
have equal rows, each under its own key; further columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.session import join_split, spread, written

ROUNDS, LEAST_SCORE, SURE_PATTERN = 4, 0.5, 0.8
#: Words that, as the last ones before a number, say that it identifies a person.
ID_LABELS = re.compile(
    r"(?:passport|identity card|social security|tax id|matriculation|pasaporte|passaporto|paspor|identidad|identidade|cpf|nik|nif|dni"
    r"|sécurité sociale|personalausweis|matrikelnummer|codice fiscale|инн|паспорт)\W*(?:no|number|nr|n\.º|n°|is)?\W*$",
    re.I,
)
#: Words after a name that make it part of the name of a prize or body.
BODY = frozenset(
    "prize foundation award medal fund institute institution lecture chair fellowship society centre center library archive archives school"
    " trust stiftung preis fondation prix fundación premio fundação prêmio fondazione yayasan hadiah фонд премия".split()
)


def _letters(kinds: tuple[str, ...]) -> str:
    """A class of characters: the letters of these Unicode categories in the alphabets that have capitals."""
    out: list[str] = []
    codes = [c for c in (*range(0x41, 0x590), *range(0x1E00, 0x2000)) if unicodedata.category(chr(c)) in kinds]
    for c in codes:
        if out and ord(out[-1][-1]) == c - 1:
            out[-1] = out[-1][0] + chr(c)
        else:
            out.append(chr(c))
    return "".join(r if len(r) == 1 else f"{r[0]}-{r[1]}" for r in out)


UP, LOW = _letters(("Lu", "Lt")), _letters(("Ll",))
WORD = rf"[{UP}][{UP}{LOW}'’]*[{UP}{LOW}](?:-[{UP}][{UP}{LOW}'’]+)*"
LINK = r"(?:de|van|von|da|di|del|della|dos|du|den|der|la|le)"
NAME = re.compile(rf"[{UP}](?:\.|[{UP}{LOW}'’-]+)(?:,? (?:{LINK} )?(?:{WORD}|[{UP}]\.))+(?![\w@])")
LOWER_NAME = re.compile(rf"(?<![\w.@/-]){WORD} [{LOW}]{{5,}}(?: [{LOW}]{{5,}})?(?= \w)")
WORDS = re.compile(r"\S+")
NUMERAL = re.compile(r"\d+")
#: Patterns begin with a class of characters, which the search skips to; what must not stand before is looked at by hand.
DIGITS = re.compile(r"\d(?:[\d ()./-]*\d)?")
NUMBER_END = re.compile(r"(?:-?[A-Z]\b)?(?: ?(?:ext|x|Ext)\.? ?\d+)?(?![\w@])")
ID_START = re.compile(r"(?:(?<=\W)|^)[A-Z]{1,2}$")
AT_SIGNS = ("@", "[at]", "(at)", "{at}", "[ at ]", "( at )", "{ at }", " at ", " AT ", "(AT)", "[AT]", "{AT}")
DOMAIN = re.compile(r"[\w-]+(?:(?:\.| ?[\[({] ?(?:dot|DOT) ?[\])}] ?| (?:dot|DOT) )[\w-]+)+")
HOUSE = r"\d{1,4}(?: ?[a-z]\b| bis\b)?"
POST = r"\b\d{4,6}\b"
TOWN = rf"(?:St\. |Saint-)?{WORD}(?: (?:{LINK}|das|do|de la|am|an der|sur|upon) {WORD}| {WORD}){{0,2}}"
STREET_EN = rf"(?:St\. )?(?:{WORD} ){{1,3}}(?:{WORD})"
STREET_FR = rf"(?:rue|avenue|impasse|boulevard|place|quai|chemin|allée|passage|route) [^\n,|.\d]{{2,}}?"
STREET = (
    rf"(?:(?:Jl\. |ул\. |пр\. )?(?:{WORD}|via|viale|piazza|corso|vicolo|largo|strada)(?: (?:{LINK}|de los|de la|de las|das|do|dei|delle|degli|{WORD})){{0,4}})"
)
RU_STREET = rf"(?:(?:ул|пр|пер)\. {WORD}(?: {WORD})?|{WORD} (?:переулок|улица|проспект|площадь))"
ADDRESSES = [
    re.compile(rf"(?:Flat \d+, |Apt\.? \d+, )?(?<![\w.]){HOUSE},? (?P<s>{STREET_FR}), (?P<p>{POST} )?(?P<t>{TOWN})"),
    re.compile(rf"(?:(?:Flat|Apt\.?|Unit) \d+, )?(?<![\w.:-]){HOUSE} (?P<s>{STREET_EN}), (?P<t>{TOWN})(?:,? (?P<p>{POST}))?"),
    re.compile(
        rf"(?<![\w-])(?P<s>{STREET}),? (?:n\.º |No\. |Nr\. |nº )?{HOUSE}(?:, \d\.º \w| RT \d+/RW \d+)?, (?P<p>{POST} )?(?P<t>{TOWN})(?: (?P<q>{POST}))?"
    ),
    re.compile(rf"(?:(?P<p>{POST}), (?P<t>{TOWN}), )?(?<![\w-])(?P<s>{RU_STREET}),? (?:д|кв)\. ?\d+\w?(?:, (?:кв|к)\. ?\d+)?(?:, (?P<u>{TOWN}))?"),
]
CANDIDATE = "kind string, text string, at int, upto int, left_words string, right_word string, inst array<string>, seed boolean, town string, spelled array<string>"
#: What follows a house number.
AFTER_HOUSE = re.compile(rf"(?: ?[a-z]\b| bis\b)?(?:,| [{UP}]| RT | (?:rue|avenue|impasse|boulevard|place|quai|chemin|allée|passage|route)\b)")
#: Words before and after a house number that an address may have.
REACH = 18
#: Words of a name, links and initials included.
MOST_WORDS = 5


def addresses(text: str, runs: list[tuple[int, int]]) -> Iterator[tuple[int, re.Match, int, int]]:
    """(number of the pattern, match, start, end), looked for among the words around what may be a house number."""
    seen = set()
    for a, b in runs:
        first = re.match(r"\d+", text[a:b]).end()
        flat = text[max(0, a - 3) : a]
        if first > 4 or (text[a - 1 : a] not in (" ", "\n", "") and a) or not (AFTER_HOUSE.match(text, a + first) or flat in ("д. ", "в. ")):
            continue
        lo, hi = _words_around(text, a, b, REACH)
        window = text[lo:hi]
        for number, pattern in enumerate(ADDRESSES):
            for m in pattern.finditer(window):
                key = (number, lo + m.start(), lo + m.end())
                if key not in seen and lo + m.start() <= a < lo + m.end():
                    seen.add(key)
                    yield number, m, lo, lo + m.start()




BLANK = re.compile(r"[ \n]")


def _words_around(text: str, a: int, b: int, most: int) -> tuple[int, int]:
    """Bounds of a span with up to so many words of its line on either side, however long they are."""
    lo = a
    for _ in range(most + 1):
        line, word = text.rfind("\n", 0, lo), text.rfind(" ", 0, lo)
        lo = max(line, word)
        if lo == line:
            break
    hi = b
    for _ in range(most + 1):
        m = BLANK.search(text, hi + 1)
        hi = m.start() if m else len(text)
        if hi == len(text) or text[hi] == "\n":
            break
    return lo + 1, hi


@lru_cache(maxsize=100_000)
def plain(word: str) -> str:
    word = unicodedata.normalize("NFKD", word.lower().replace("ß", "ss").replace("ø", "o"))
    return "".join(c for c in word if not unicodedata.combining(c))


def around(text: str, a: int, b: int) -> tuple[str, str]:
    """The two words before and the one after, lower case, digits as 9; ``¶`` for the start of a line or sentence and the end of a line."""
    before = text[max(0, a - 48) : a]
    before = before[before.rfind("\n") + 1 :]
    bare = before.rstrip()
    starts = not bare or (len(bare) < len(before) and bare[-1] in ".!?…" and not bare.endswith(("Dr.", "Prof.")))
    left = "¶" if starts else " ".join(NUMERAL.sub("9", bare.lower()).split()[-2:])
    word = text[b : b + 32].partition("\n")[0].split(None, 1)
    return left[-40:], NUMERAL.sub("9", word[0].lower())[:24] if word else "¶"


def _spots(text: str, marks: tuple[str, ...]) -> Iterator[tuple[int, str]]:
    for mark in marks:
        i = text.find(mark)
        while i >= 0:
            yield i, mark
            i = text.find(mark, i + 1)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of e-mail addresses, disguised or not."""
    done = 0
    for at, mark in sorted(_spots(text, AT_SIGNS)):
        if at < done:
            continue
        word = mark.strip() in ("at", "AT")
        after = at + len(mark)
        gap_l = gap_r = 0
        if not word:
            gap_l = 2 if text[max(0, at - 2) : at] == "  " else int(text[at - 1 : at] == " ")
            gap_r = 2 if text[after : after + 2] == "  " else int(text[after : after + 1] == " ")
            if gap_l > 1 or gap_r > 1 or (mark == "@" and gap_l != gap_r):
                continue
        domain = DOMAIN.match(text, after + gap_r)
        if not domain or (word and not re.search(r"dot|DOT", domain.group())) or re.split(r"\W+", domain.group())[-1].isdigit():
            continue
        end = start = at - gap_l
        while start > done and (text[start - 1].isalnum() or text[start - 1] in "_.+-"):
            start -= 1
        start += len(text[start:end]) - len(text[start:end].lstrip(".+-"))
        if start < end:
            done = domain.end()
            yield start, done


def shape(number: str) -> str:
    return re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", re.sub(r" ?(?:ext|x|Ext)\.? ?\d+$", "", number)))


def numbers(text: str, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Spans of number groups of seven digits or more and of one or two letters with six digits or more.

    ``runs``: spans of digits and the marks between them.
    """
    for a, b in runs:
        if b - a < 6:
            continue
        lead = ID_START.search(text[max(0, a - 3) : a])
        if lead:
            stop = re.compile(r"\d{6,8}[A-Z]?(?!\w)").match(text, a)
            if stop:
                yield a - len(lead.group()), stop.end()
            continue
        s = text[a:b]
        if ")" in s and "(" not in s[: s.index(")")] and text[a - 1 : a] != "(":
            b = a + len(s[: s.index(")")].rstrip())
            s = text[a:b]
        if text[a - 1 : a] == "(" and ")" in s:
            a -= 1
        if text[a - 1 : a] == "+":
            a -= 1
        elif text[a - 2 : a] == "(+":
            a -= 1
        if text[a - 1 : a].isalnum() or text[a - 1 : a] in (".", "@", "/", "_") and a:
            continue
        end = NUMBER_END.match(text, b)
        if end and sum(c.isdigit() for c in s) >= 7:
            yield a, end.end()


@lru_cache(maxsize=200_000)
def name_parts(text: str) -> tuple[str, str] | None:
    """First and last token (of a double name its first half), or None if there are fewer than two."""
    words = [w for w in re.split(r"[ ,]+", text) if not (re.fullmatch(LINK, w) or re.fullmatch(rf"[{UP}]\.", w))]
    return None if len(words) < 2 else (plain(words[0]).split("-")[0], plain(words[-1]).split("-")[0])


def _free_of_bodies(text: str, words: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Stretches of words, parted by commas, without the parts between commas that name a prize or body."""
    start, part = 0, 0
    for k, (x, y) in enumerate(words, 1):
        if text[y - 1] == "," or k == len(words):
            if any(plain(text[a:b]).strip(".,") in BODY for a, b in words[part:k]):
                if part > start:
                    yield start, part
                start = k
            part = k
    if part > start:
        yield start, part


def names(text: str) -> Iterator[tuple[int, int]]:
    """Capitalised sequences, what is left of them without the first or last words, and all their parts of two to five words.

    A comma may part names as well as the two halves of one; a part between commas that names a prize or body is none.
    """
    for m in NAME.finditer(text):
        a, b = m.span()
        if a and (text[a - 1].isalnum() or text[a - 1] in "_.@/-"):
            continue
        if b < len(text) and (text[b].isalnum() or text[b] in "_@"):
            b = a + m.group().rfind(" ")  # the match stopped inside a word
            if b <= a or " " not in text[a:b]:
                continue
        words = [(a + w.start(), a + w.end()) for w in WORDS.finditer(text[a:b])]
        for first, last in _free_of_bodies(text, words):
            for i in range(first, last):
                # a window, or the whole but for two words at either end
                ends = {*range(i + 2, min(last, i + MOST_WORDS) + 1), *(range(max(i + 2, last - 2), last + 1) if i <= first + 2 else ())}
                for j in sorted(ends, reverse=True):
                    x, y = words[i][0], words[j - 1][1]
                    y -= text[y - 1] == ","
                    part = text[x:y]
                    if part[0].isupper() and name_parts(part) and not re.fullmatch(LINK, text[slice(*words[j - 1])].rstrip(",")):
                        yield x, y
    for at, mark in _spots(text, ("Dr. ", "Prof. ", "Mr. ", "Ms. ", "Mrs. ")):
        low = LOWER_NAME.match(text, at + len(mark))
        if low:
            yield at + len(mark), at + len(mark) + re.match(r"\S+ \S+", low.group()).end()


def candidates(text: str) -> Iterator[tuple]:
    """Rows of ``CANDIDATE`` for one text."""
    spans = []
    for a, b in emails(text):
        spans.append((a, b))
        local = re.split(r"[^\w.]", plain(text[a:b]), maxsplit=1)[0].split(".")
        pair = [w for w in local if w.isalpha() and len(w) > 2]
        left, right = around(text, a, b)
        yield "email", text[a:b], a, b, left, right, ["@"], True, "", pair if len(pair) == 2 and len(local) == 2 else []
    inside = lambda a, b: any(x < b and a < y for x, y in spans)
    runs = [m.span() for m in DIGITS.finditer(text)]
    for a, b in numbers(text, runs):
        if inside(a, b):
            continue
        s, (left, right) = text[a:b], around(text, a, b)
        form = shape(s)
        label = bool(ID_LABELS.search(text[max(0, a - 40) : a]))
        yield "phone", s, a, b, left, right, [form], s.startswith("+") and not label, "", []
        yield "idnum", s, a, b, left, right, [form], label, "", []
    seen = set()
    for number, m, lo, start in addresses(text, runs):
        g = m.groupdict()
        post = bool(g.get("p") or g.get("q"))
        left, right = around(text, start, lo + m.end())
        town = g.get("t") or g.get("u") or ""
        for cut in range(town.count(" ") + 1):
            # a town may be followed by the next sentence without a mark
            short = town.rsplit(" ", cut)[0] if cut else town
            end = lo + (m.end() if not cut else (m.start("t") if g.get("t") else m.start("u")) + len(short))
            if cut and ((g.get("t") and m.end("t") != m.end()) or not (short and short[-1].isalpha())):
                break
            if (start, end) not in seen:
                seen.add((start, end))
                # unsure only where a capital follows, which may belong to the town or begin a sentence
                firm = not re.match(rf" [{UP}]", text[end : end + 2]) or text[end - 1].isdigit()
                sure = post or number == len(ADDRESSES) - 1
                yield "address", text[start:end], start, end, left, right, [plain(g["s"])], sure, ("!" if firm else "?") + plain(short), []
    for a, b in names(text):
        if inside(a, b):
            continue
        left, right = around(text, a, b)
        yield "name", text[a:b], a, b, left, right, [*name_parts(text[a:b])], False, "", []


def extract(docs: DataFrame, key: str, text: str) -> DataFrame:
    """All candidates of all texts: ``key`` and the columns of ``CANDIDATE``."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [key, *[c.split()[0] for c in CANDIDATE.split(", ")]]
        for b in batches:
            rows = [(k, *c) for k, t in zip(b[key], b[text], strict=True) for c in candidates(t)]
            yield pd.DataFrame(rows, columns=columns)

    return spread(docs.select(key, text)).where(f"`{text}` != ''").mapInPandas(run, f"`{key}` {kind}, {CANDIDATE}")


def score_graph(found: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(patterns, instances) with their scores and ``uses``, how many candidates hold them: the pattern-instance graph, scored in turn."""
    pattern = F.concat_ws(" _ ", "left_words", "right_word").alias("pattern")
    spelled = found.where("kind = 'email' and size(spelled) = 2").select(F.array_sort("spelled").alias("pair")).distinct().withColumn("known", F.lit(True))
    # an address may have variants of different length; it counts once
    rows = found.where("kind != 'address' or town not like '?%'").groupBy("kind", pattern, "inst").agg(F.count("*").alias("n"), F.count_if("seed").alias("seeds"))
    names = rows.where("kind = 'name'").withColumn("pair", F.array_sort("inst")).join(spelled.hint("merge"), "pair", "left")
    names = names.withColumn("seeds", F.when(F.col("known"), F.col("n")).otherwise(F.col("seeds")))
    rows = rows.where("kind != 'name'").unionByName(names.select(*rows.columns))
    edges = rows.select("kind", "pattern", F.explode("inst").alias("node"), "n", "seeds")
    edges = written(edges.groupBy("kind", "pattern", "node").agg(F.sum("n").alias("n"), F.sum("seeds").alias("seeds")))
    total = edges.count()
    of_nodes = edges.groupBy("kind", "node").agg((F.sum("seeds") > 0).alias("seeded"), F.count("*").alias("edges"), F.sum("n").alias("uses"))
    nodes = written(of_nodes.withColumn("score", F.col("seeded").cast("double")))
    patterns = None
    for _ in range(rounds):
        known = join_split(edges, nodes.select("kind", "node", "score", "edges"), ("kind", "node"), "edges", total)
        patterns = written(
            known.groupBy("kind", "pattern").agg(
                (F.sum(F.col("n") * F.col("score")) / (F.sum("n") + 0.2)).alias("score"), F.sum("n").alias("uses"), F.count("*").alias("edges")
            )
        )
        by_pattern = join_split(edges, patterns.select("kind", "pattern", F.col("score").alias("p"), "edges"), ("kind", "pattern"), "edges", total)
        again = by_pattern.groupBy("kind", "node").agg(
            (F.sum(F.col("n") * F.col("p")) / (F.sum("n") + 0.2)).alias("mean"), (F.sum("seeds") > 0).alias("seeded"), F.count("*").alias("edges"), F.sum("n").alias("uses")
        )
        score = F.when(F.col("seeded"), 1.0).otherwise(F.least("mean", F.lit(0.95)))
        nodes = written(again.select("kind", "node", score.alias("score"), "edges", "uses"))
    return patterns, nodes


def accepted(found: DataFrame, key: str) -> DataFrame:
    """``key, kind, text, at, upto, score`` of the candidates that are cases."""
    found = written(found)
    patterns, nodes = score_graph(found)
    total = found.count()
    first, second = F.get("inst", F.lit(0)), F.get("inst", F.lit(1))
    body = F.regexp_replace("right_word", r"[^\p{L}]", "").isin(*BODY)
    rest = found.select(
        key, "kind", "text", "at", "upto", "seed", "town", body.alias("body"), F.concat_ws(" _ ", "left_words", "right_word").alias("pattern"),
        first.alias("n0"), F.coalesce(second, first).alias("n1"),
    )
    pats = patterns.select("kind", "pattern", F.col("score").alias("p"), F.col("uses").alias("support"), "uses")
    rest = written(join_split(rest, pats, ("kind", "pattern"), "uses", total, "left").drop("pattern"))
    for i in (0, 1):
        side = nodes.select("kind", F.col("node").alias(f"n{i}"), F.col("score").alias(f"s{i}"), "uses")
        rest = written(join_split(rest, side, ("kind", f"n{i}"), "uses", total, "left"))
    zero = F.lit(0.0)
    low, high = F.least(F.coalesce("s0", zero), F.coalesce("s1", zero)), F.greatest(F.coalesce("s0", zero), F.coalesce("s1", zero))
    pattern = F.when(F.col("support") >= 3, F.coalesce("p", zero)).otherwise(zero)
    score = (
        F.when(F.col("seed"), 1.0)
        .when((F.col("kind") == "name") & F.col("body"), 0.0)
        .when(F.col("kind") == "name", F.greatest(low, F.when(pattern >= SURE_PATTERN, pattern * F.greatest(high, F.lit(0.6))).otherwise(0.0)))
        .otherwise(F.greatest(F.coalesce("s0", zero), F.when(pattern >= SURE_PATTERN, pattern).otherwise(0.0)))
    )
    town = F.substring("town", 2, 200_000_000).alias("name")
    towns = found.where("kind = 'address'").groupBy(town).agg(F.count("*").alias("uses"), F.count_if(F.col("town").startswith("!")).alias("n_town"))
    rest = rest.withColumn("score", score).where(F.col("score") >= LEAST_SCORE)
    places = written(rest.where("kind = 'address'").select(key, "kind", "text", "at", "upto", "score", "town", town))
    places = join_split(places, towns.where("n_town >= 2").select("name", F.lit(True).alias("town_known"), "uses"), ("name",), "uses", total, "left")
    firm = F.coalesce("town_known", F.lit(False)) | F.col("town").startswith("!") | (F.col("town") == "?")
    # no variant of the town known anywhere: the shortest one, below all others
    places = places.withColumn("score", F.when(firm, F.col("score")).otherwise(0.4 - F.length("text") / 1000))
    columns = [key, "kind", "text", "at", "upto", "score"]
    return _longest(rest.where("kind != 'address'").select(*columns).unionByName(places.select(*columns)), key)


def _longest(found: DataFrame, key: str) -> DataFrame:
    """Of overlapping candidates the one with the higher score; ties: the longest, then the first kind by name.

    A document's candidates are bounded by its own text, so they are gathered in one row.
    """
    kind = dict(found.dtypes)[key]
    rows = found.groupBy(key).agg(F.collect_list(F.struct(F.round("score", 2).alias("score"), "at", "upto", "kind", "text")).alias("spans"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, spans in zip(b[key], b["spans"], strict=True):
                starts: list[int] = []  # of the spans taken, in order
                ends: list[int] = []
                for x in sorted(spans, key=lambda x: (-x["score"], x["at"] - x["upto"], x["kind"], x["at"])):
                    i = bisect_left(starts, x["upto"])
                    if not i or ends[i - 1] <= x["at"]:
                        starts.insert(i, x["at"])
                        ends.insert(i, x["upto"])
                        out.append((k, x["kind"], x["text"], x["at"], x["upto"], x["score"]))
            yield pd.DataFrame(out, columns=[key, "kind", "text", "at", "upto", "score"])

    return rows.mapInPandas(run, f"`{key}` {kind}, kind string, text string, at int, upto int, score double")


def mask(docs: DataFrame, key: str, text: str, found: DataFrame) -> DataFrame:
    """``key`` and the text with ``<EMAIL>``, ``<PHONE>``, ... in place of each case; other texts unchanged."""
    spans = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "upto", "kind"))).alias("_spans"))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t, s in zip(b[text], b["_spans"], strict=True):
                if s is None or t is None:
                    out.append(t)
                    continue
                parts, last = [], 0
                for x in s:
                    parts += [t[last : x["at"]], f"<{x['kind'].upper()}>"]
                    last = x["upto"]
                out.append("".join([*parts, t[last:]]))
            yield pd.DataFrame({key: b[key], text: out})

    return docs.select(key, text).join(spans, key, "left").mapInPandas(run, f"`{key}` {kind}, `{text}` string")
