import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colophon.llm import encoding_repair as er
from colophon.llm import language_labels as ll
from colophon.llm import personal_information as pi
from colophon.llm import queries

CLEAN = [
    "Las señales de desconfianza hacia el titular corregido según las respuestas del público más joven.", "L’équipe de rédaction mesure l’écart entre le cité et le non-cité.",
    "Die Lektüre der Regionalpresse erfasst die Rolle der Übersetzung.", "Небольшая редакция сравнивает неравное использование открытых хранилищ.",
    "The so-called “quiet archive” of local radio: naïve readings of 1998–2006.",
    "НЕБОЛЬШАЯ РЕДАКЦИЯ СРАВНИВАЕТ НЕРАВНОЕ ИСПОЛЬЗОВАНИЕ ОТКРЫТЫХ ХРАНИЛИЩ: РАЙОННАЯ ГАЗЕТА О ТЕХ, КТО ИЗБЕГАЕТ НОВОСТЕЙ.",
] * 60


@pytest.fixture(scope="module")
def garbled():
    out = {}
    for i, text in enumerate(CLEAN[:5]):
        for j, page in enumerate(("cp1252", "cp1251", "mac_roman", "cp437", "cp850")):
            table = er.code_page(page)
            out[f"{i}-{j}"] = (text, "".join(table[b] for b in text.encode()))
    rus = CLEAN[3]
    out["swap"] = (rus, rus.encode("cp1251").decode("cp1252"))
    out["koi"] = (rus, rus.encode("koi8-r").decode("cp1251"))
    double = "".join(er.code_page("cp1252")[b] for b in "".join(er.code_page("cp1252")[b] for b in CLEAN[0].encode()).encode())
    out["double"] = (CLEAN[0], double)
    out["part"] = (CLEAN[0] + " " + CLEAN[1], CLEAN[0] + " " + "".join(er.code_page("cp1252")[b] for b in CLEAN[1].encode()))
    return out


def test_round_trip(spark, garbled):
    rows = [(f"c{i}", t, "") for i, t in enumerate(CLEAN)] + [(k, g, None) for k, (_, g) in garbled.items()]
    rows += [("lost", "A caf� debate", ""), ("lost2", "Como as pequenas reda??es negociam", ""), ("ask", "Who reads this?", None), ("null", None, "x"), ("long", CLEAN[0] * 500, None)]
    df = spark.createDataFrame(rows, "id string, title string, text string")
    got = {(r["id"], r["field_name"]): r for r in er.repair(df, "id", ["title", "text"]).collect()}
    for k, (text, bad) in garbled.items():
        if bad != text:
            assert got[k, "title"]["repaired"] == text, (k, got[k, "title"]["repaired"])
            assert got[k, "title"]["text_md5"] == hashlib.md5(text.encode()).hexdigest()
    assert got["lost", "title"]["text_md5"] == "" == got["lost2", "title"]["text_md5"] and got["lost", "title"]["lost"]
    assert {k for k, _ in got} == {k for k, (t, g) in garbled.items() if t != g} | {"lost", "lost2"}
    assert er.repair(df.limit(0), "id", ["title"]).count() == 0


def test_confusions_beyond_the_list(spark):
    polish = "Większość małych redakcji mierzy różnicę między źródłem a cytatem, choć część głosów pozostaje ściśle społeczna."
    read = lambda data, page: "".join(er.code_page(page)[b] for b in data)
    garbled = {
        "mac": (CLEAN[3], read(CLEAN[3].encode(), "mac_cyrillic")), "855": (CLEAN[3], read(CLEAN[3].encode(), "cp855")),
        "koi": (CLEAN[3], read(CLEAN[3].encode("koi8-r"), "cp866")), "1250": (polish, read(polish.encode("cp1250"), "cp1252")),
    }
    rows = [(f"c{i}", t) for i, t in enumerate([*CLEAN, *[polish] * 60])] + [(k, g) for k, (_, g) in garbled.items()]
    got = {r["id"]: r["repaired"] for r in er.repair(spark.createDataFrame(rows, "id string, title string"), "id", ["title"]).collect()}
    assert got == {k: t for k, (t, _) in garbled.items()}


def test_the_learned_letter_decides():
    model = er.Model({(ord(a), ord(b)): 5.0 for a in "абв " for b in "абв "})
    swap = er.cipher_of("cp1251>cp1252")
    assert model.decode(swap, "à☃") == "а☃"
    rows = [(swap.name, unit, letter) for unit, letter in (("à", "б"), ("☃", "в"))]
    model.improve(pd.DataFrame([(c, " ", u, " ", x, 50.0) for c, u, x in rows], columns=["cipher", "left", "unit", "right", "letter", "n"]))
    assert model.decode(swap, "à☃") == "бв"


def test_no_expectation_is_cut(spark, monkeypatch):
    rows = [(f"c{i}", t) for i, t in enumerate(CLEAN)] + [("g", CLEAN[0].encode().decode("cp1252"))]
    texts = er.fields_of(spark.createDataFrame(rows, "id string, title string"), "id", ["title"])
    counts = er.count_bigrams(texts)
    monkeypatch.setattr(er, "count_bigrams", lambda _: dict(counts))
    model, _ = er.learn(texts, 1)
    assert {er.cipher_of("utf-8>cp1252").by_the_book(u) for u in model.learned["utf-8>cp1252"]} == set("ñíúá") & set(CLEAN[0])


def test_language_model_on_held_out_texts(spark, sf):
    df = spark.read.parquet(f"{sf}/sample_records_language_title_abstract.parquet")
    codes = spark.read.parquet(f"{sf}/language_codes.parquet")
    texts = er.fields_of(df, "id", ["title", "abstract"])
    model = ll.train(df, codes, texts, 400)
    assert {"eng", "spa", "ind"} <= set(model.classes)
    said = {
        "The visibility of community journals among students": "eng", "LA ENCUESTA DOCUMENTA LA DISTANCIA ENTRE LO CITADO": "spa", "Penelitian ini mengukur pendapat umum pada tahun kemarau": "ind",
        "A nossa analise discute a informacao publica em anos de seca": "por",
    }
    best = model.log_proba(list(said)).argmax(axis=1)
    assert [model.classes[i] for i in best] == list(said.values())
    mixed = "The survey traces the gap between cited and uncited work. " * 2 + "La encuesta mide la opinión pública en años de sequía (the survey). " * 2 + "KW: trust, radio"
    got = ll.segments(model, [mixed, "", "123"], [False, False, True])
    assert [g[0] for g in got[0]] == ["eng", "spa"] and len(got[1]) == len(got[2]) == 1
    assert all(0 <= g[2] <= 1 for s in got for g in s)


def test_rare_languages_stay_and_mistaken_labels_go():
    chance = random.Random(2)
    words = {
        "eng": "the of gap survey between cited work newspaper which editors measure public opinion years drought local community journal trust".split(),
        "spa": "la el de encuesta mide entre lo citado trabajo periódico que editores opinión pública años sequía comunidad revista confianza".split(),
        "deu": "der die das zwischen zitierte arbeit zeitung welche redaktion misst öffentliche meinung jahre dürre gemeinschaft vertrauen und nicht".split(),
    }
    text = lambda lang: " ".join(chance.choice(words[lang]) for _ in range(9))
    rows = [("eng", text("eng")) for _ in range(1500)] + [("spa", text("spa")) for _ in range(1490)] + [("deu", text("deu")) for _ in range(8)]
    rows += [("nld", text("eng")) for _ in range(12)] + [("eng", text("spa")) for _ in range(60)]
    chance.shuffle(rows)
    df = pd.DataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], columns=["h", "text", "label"])
    model, held = ll.fit_labelled(df, np.ones(1 << ll.BITS))
    assert model.classes == ["deu", "eng", "spa"]
    fresh = [(text(lang), lang) for lang in words for _ in range(40)]
    said = model.logits([t for t, _ in fresh]).argmax(axis=1)
    assert sum(model.classes[i] == lang for i, (_, lang) in zip(said, fresh, strict=True)) >= 114
    # confidences keep what they promise, and short pieces have less
    pieces = [(t[a : a + n], model.classes.index(lang)) for t, lang in fresh if lang != "deu" for a, n in ((0, 60), (0, 14), (5, 7), (3, 4))]
    table = ll.reliability(model, [t for t, _ in pieces], [k for _, k in pieces])
    assert (table["calibration_error"] < 0.1).all() and (table["log_loss"] < 0.7).all()
    assert table["confidence"].iloc[0] < table["confidence"].iloc[-1] < 1


def test_ngrams_stay_inside_their_text():
    ids, sizes = ll.grams(["ab", "", "abc"])
    one, _ = ll.grams(["abc"])
    assert sizes.sum() == len(ids) and (ids[sizes[:2].sum() :] == one).all()


def test_path_prefers_few_changes():
    s = np.log(np.array([[0.9, 0.1], [0.4, 0.6], [0.9, 0.1], [1e-6, 1], [1e-6, 1]]))
    assert ll.path(s, 3.0).tolist() == [0, 0, 0, 1, 1]


def test_labels_in_any_spelling(spark, sf):
    codes = spark.read.parquet(f"{sf}/language_codes.parquet")
    rows = ["spa", " ES ", "es-MX", "Spanish", "__label__spa_Latn", "es_Latn", "und?", "", None, "-"]
    df = spark.createDataFrame([(r,) for r in rows], "v string")
    assert [r[0] for r in df.select(ll.named(F.col("v"), codes)).collect()] == ["spa"] * 6 + [None] * 4


def test_p2_p4_shapes(spark, sf):
    codes = {r[0] for r in spark.read.parquet(f"{sf}/language_codes.parquet").select("lang_code").collect()}
    got = queries.p2_found(spark, sf).collect()
    assert got and {r["lang_code"] for r in got} <= codes and all((r["seg_no"] == 0) == (r["field_name"] != "abstract") for r in got)


TEXT = """Interviewee Olga Yarrowmond asked to pause here. The Olga Yarrowmond Prize is awarded. Yarrowmond (2003) calls this silent.
Please write to olga.yarrowmond@uni-x.example or h-b [at] mail [dot] y [dot] test. The @press handle gained 7481 followers.
Tel. +44 1632 960513. T: 387-555-0199. Pages 1894-1513 are missing. Passport no. Q5644299 was copied. ISBN 978-0-359904-984-5.
Send the form to 71b Quayside Terrace, Velvetwick, 92279. The square in front of Quayside Terrace became a stage."""


def test_candidates():
    kinds = {}
    for kind, text, a, b, *_ in pi.candidates(TEXT):
        assert TEXT[a:b] == text
        kinds.setdefault(kind, set()).add(text)
    assert kinds["email"] == {"olga.yarrowmond@uni-x.example", "h-b [at] mail [dot] y [dot] test"}
    assert {"+44 1632 960513", "387-555-0199", "Q5644299"} <= kinds["phone"] and "71b Quayside Terrace, Velvetwick, 92279" in kinds["address"]
    assert "Olga Yarrowmond" in kinds["name"] and not any("Prize" in n for n in kinds["name"])


def test_nothing_is_cut():
    domain = ".".join(f"label{i}" for i in range(30)) + ".example"
    local = "a" * 40 + "." + "b" * 80
    street = "Straße" + "langer" * 30
    text = f"Write to x@{domain} or {local}@y.example. Adresse: {street} 12, 01234 Ort. Signed by {'Aa' * 60} {'Bb' * 60}, who left."
    got = {(k, t) for k, t, *_ in pi.candidates(text)}
    assert ("email", f"x@{domain}") in got and ("email", f"{local}@y.example") in got and ("name", f"{'Aa' * 60} {'Bb' * 60}") in got
    assert ("address", f"{street} 12, 01234 Ort") in got
    assert pi._words_around("a b\nc dd 12 e\nf", 9, 11, 1) == (6, 13) and pi._words_around("12 e", 0, 2, 1) == (0, 4)


def test_names_in_any_alphabet_with_capitals():
    for name in ("Γιάννης Παπαδόπουλος", "Անի Պետրոսյան", "Łukasz Żółć", "Иван Петров"):
        assert ("name", name) in {(k, t) for k, t, *_ in pi.candidates(f"signed by {name} today")}


def test_names_in_long_sequences():
    names = lambda t: {t[a:b] for a, b in pi.names(t)}
    assert {"Anna Meyer", "Bob Smith", "Carl Jones"} <= names("Anna Meyer, Bob Smith, Carl Jones wrote this.")
    assert names("Anna Meyer, Institute Of Media wrote this.") == {"Anna Meyer"}
    assert "JOHN FOSTER" in names("EVERY DAY THE EDITOR JOHN FOSTER READ THE NEWS ALOUD") and "Meyer, Anna" in names("Meyer, Anna wrote this.")
    assert len(names("WORD OTHER " * 1000)) < 100


def test_found_and_masked(spark):
    # seeds and patterns need company
    more = [(i, f"{TEXT}\nmob. +44 1632 96{i:04d}\nT: +1 555 555 {i:04d}\nInterviewee Nadia Estravelo asked to pause here. x nadia.estravelo@y.test") for i in range(10, 16)]
    df = spark.createDataFrame([(1, TEXT, "c"), (2, None, "c"), (3, "", "c"), (4, "word " * 30_000, "c"), *((i, t, "c") for i, t in more)], "doc_id bigint, text string, kind string")
    found = pi.accepted(pi.extract(df, "doc_id", "text"), "doc_id")
    mine = {(r["kind"], r["text"]) for r in found.where("doc_id = 1").collect()}
    assert {("name", "Olga Yarrowmond"), ("phone", "+44 1632 960513"), ("idnum", "Q5644299"), ("email", "olga.yarrowmond@uni-x.example"), ("address", "71b Quayside Terrace, Velvetwick, 92279")} <= mine
    assert not any("1894" in t or "978" in t for _, t in mine)
    masked = {r["doc_id"]: r["text"] for r in pi.mask(df, "doc_id", "text", found).collect()}
    assert masked[2] is None and masked[3] == "" and len(masked[4]) == 150_000 and len(masked) == 10
    assert "<PHONE>" in masked[1] and "olga.yarrowmond@" not in masked[1] and "<NAME> Prize" not in masked[1]
    assert pi.accepted(pi.extract(df.limit(0), "doc_id", "text"), "doc_id").count() == 0
