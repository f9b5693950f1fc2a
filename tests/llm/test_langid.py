import unicodedata
from collections import Counter
from itertools import product

import numpy as np
from meshwave.llm import langid
from pyspark.sql import functions as F


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(0)
    for _ in range(40):
        lengths = rng.integers(0, 6, 5)
        first = np.concatenate([[0], np.cumsum(lengths)])
        s = rng.normal(size=(first[-1], 3)).astype(np.float32) * 2
        path = langid.viterbi(s, first, 1.5)
        for i, n in enumerate(lengths):
            part = s[first[i] : first[i + 1]].astype(float)
            value = lambda p: sum(part[t, x] for t, x in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, B905, E731
            if n:
                assert np.isclose(value(path[first[i] : first[i + 1]].tolist()), max(value(p) for p in product(range(3), repeat=int(n))))


def test_held_out_accuracy(spark, small):
    found = langid.op4_language_id(spark, small)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang")
    assert found.count() == docs.count()
    held = found.where("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert held > 0.97


def test_edge_cases_and_spans(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = langid.learn_from_documents(docs)
    en, de = (docs.where(f"lang = '{x}' and length(text) between 800 and 3000").first()["text"] for x in ("en", "de"))
    mixed = en + "\n" + de
    data = [(1, None, "a"), (2, "", "b"), (3, "123 .,", "c"), (None, mixed, "d"), (4, "漢字" * 5, "e"), (5, "the " * 60_000, "f"), (5, "the " * 60_000, "f")]
    rows = langid.identify(spark.createDataFrame(data, "doc_id long, text string, score string"), model, spans=True).collect()
    assert len(rows) == 7
    by = {r["doc_id"]: r for r in rows}
    for i in (1, 2, 3):
        assert (by[i]["lang_pred"], by[i]["score"], by[i]["n_spans"]) == ("und", 0.0, 0)
    assert by[4]["lang_pred"] in model.langs and by[5]["lang_pred"] == "en" and 0 <= by[5]["score"] <= 1
    spans = by[None]["spans"]
    assert [s["lang"] for s in spans] == ["en", "de"]
    assert abs(spans[1]["start"] - len((en + "\n").encode())) < 40
    assert mixed.encode()[spans[0]["start"] : spans[0]["end"]].decode().startswith(en[:20].strip())
    assert langid.identify(docs.limit(0), model).count() == 0
    assert langid.identify(docs.select("doc_id", "text").limit(3), langid.train(docs.limit(0))).where("lang_pred = 'und'").count() == 3


def test_scripts_narrow_candidates(spark):
    rows = [(f"слово дело мир {i}", "ru") for i in range(30)] + [(f"word deed world {i}", "en") for i in range(30)]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"))
    got = langid.identify(spark.createDataFrame([(1, "новый мир"), (2, "new world")], "doc_id int, text string"), model)
    assert {r["doc_id"]: r["lang_pred"] for r in got.collect()} == {1: "ru", 2: "en"}


def test_letters_are_code_points(spark):
    """A Cyrillic letter counts as much as a Latin one; marks and signs count nothing."""
    rows = [(f"слово дело мир {i}", "ru") for i in range(30)] + [(f"word deed world {i}", "en") for i in range(30)]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"))
    text = "word deed world " * 6 + "… «» — " + "слово дело мир " * 3
    (got,) = langid.identify(spark.createDataFrame([(1, text)], "doc_id int, text string"), model).collect()
    assert (got["lang_pred"], round(got["score"], 9)) == ("en", round(78 / (78 + 36), 9))


def test_letters_against_unicode():
    text = "aé Ωж-ц’ 漢字、カナ 한글 नमस्ते ẽ 𐍈 𠀀 1² ª µ … «x»\u0301"
    data = np.frombuffer(text.encode(), np.uint8)
    inside, bits = langid._letters(data)
    at = 0
    for c in text:
        n = len(c.encode())
        kind = unicodedata.category(c)[0]
        assert inside[at : at + n].all() == inside[at : at + n].any() == (kind in "LM") and (bits[at] > 0) == (kind == "L") and not bits[at + 1 : at + n].any()
        at += n


def test_many_languages_and_empty_ones(spark):
    """Every language with words is learned, over 255 too; one whose texts are null, empty or without letters is not."""
    rows = [(f"w{a}{b}x q{b}{a}z " * 5, f"l{i:03d}") for i, (a, b) in enumerate(product("abcdefghijklmnopqrst", repeat=2)) if i < 300 for _ in range(2)]
    rows += [(None, "nul"), ("", "emp"), ("123 ... 4", "dig"), ("текст без языка", None)]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"), limit=10)
    assert model.langs == [f"l{i:03d}" for i in range(300)]
    docs = spark.createDataFrame([(i, rows[2 * i][0]) for i in range(300)] + [(900, "кириллица"), (901, "9")], "doc_id int, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, model).collect()}
    assert sum(got[i] == f"l{i:03d}" for i in range(300)) >= 290 and got[900] in model.langs and got[901] == "und"


def test_word_scores_and_vote_against_brute_force(spark):
    """Scores of words from plain counts, the vote by letters, on texts of two languages."""
    rows = [(f"alpha beta gamma delta {i % 3}", "xx") for i in range(20)] + [(f"omega sigma beta kappa {i % 3}", "yy") for i in range(20)]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"))
    counts = {"xx": Counter(), "yy": Counter()}
    for text, lang in rows:
        for w in text.split():
            if w.isalpha():
                p = f" {w} "
                for n in (2, 3, 4):
                    counts[lang].update((n, p[i : i + n]) for i in range(len(p) - n + 1))
                counts[lang][0, w] += 1
    total = {(x, n): sum(c for (m, _), c in counts[x].items() if m == n) + 0.1 * (1 << langid.BITS) for x in counts for n in langid.ORDERS}

    def value(w, lang):
        p, out = f" {w} ", 0.0
        for n in langid.ORDERS:
            keys = [(n, p[i : i + n]) for i in range(len(p) - n + 1)] if n else [(0, w)]
            out += sum(np.log((counts[lang][k] + 0.1) / total[lang, n]) for k in keys) / (2.0 if n > 2 else 1.0)
        return out

    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["alpha", "beta", "omega", "sigma", "delta", "kappa", "betas", "gam"], 7)) for _ in range(40)]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), model).collect()}
    for i, text in enumerate(texts):
        w = text.split()
        s = [[value(x, lang) for lang in ("xx", "yy")] for x in w]
        path = max(product(range(2), repeat=len(w)), key=lambda p: sum(s[t][x] for t, x in enumerate(p)) - langid.SWITCH * sum(a != b for a, b in zip(p, p[1:])))  # noqa: B023, B905
        share = [sum(len(x) for x, y in zip(w, path, strict=True) if y == k) for k in (0, 1)]
        assert got[i]["lang_pred"] == ("xx", "yy")[share[1] > share[0]] and abs(got[i]["score"] - max(share) / sum(share)) < 1e-9
