from __future__ import annotations

import math
import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import language as L


def test_em_finds_the_best_proportions():
    rng = np.random.default_rng(3)
    p, n = rng.random((30, 2)) + 0.01, rng.integers(1, 9, 30).astype(float)
    w, score = L.proportions(p, n, rounds=2000)
    grid = np.linspace(0, 1, 2001)[1:-1]
    best = max(float(n @ np.log(p @ np.array([a, 1 - a]))) for a in grid)
    assert abs(w.sum() - 1) < 1e-6 and score >= best - 1e-2


def brute_infer(columns, counts, penalty=L.PENALTY):
    """The language set and shares by plain loops: the set grows by the language that raises the likelihood most, while that pays."""
    total = sum(counts)
    price = penalty * math.log(max(total, 2))

    def fitted(ks):
        w = [1 / len(ks)] * len(ks)
        for _ in range(400):
            sums = [0.0] * len(ks)
            for g, n in enumerate(counts):
                parts = [w[x] * columns[k][g] for x, k in enumerate(ks)]
                for x, v in enumerate(parts):
                    sums[x] += n * v / sum(parts)
            w = [x / total for x in sums]
        return sum(n * math.log(sum(w[x] * columns[k][g] for x, k in enumerate(ks))) for g, n in enumerate(counts)), w

    chosen, best, shares = [], -math.inf, []
    while len(chosen) < len(columns):
        score, k, w = max((fitted([*chosen, k])[0], -k, fitted([*chosen, k])[1]) for k in range(len(columns)) if k not in chosen)
        if chosen and score - best <= price:
            break
        chosen, best, shares = [*chosen, -k], score, w
    return dict(zip(chosen, shares, strict=True))


def test_mixtures_against_loops():
    rng = np.random.default_rng(8)
    for _ in range(25):
        k, g = int(rng.integers(1, 4)), 25
        p = rng.dirichlet(np.full(g, 0.4), k).T + 1e-4
        p /= p.sum(axis=0)
        n = rng.multinomial(int(rng.integers(5, 400)), p @ rng.dirichlet(np.full(k, 0.5))).astype(float)
        n[0] += 1
        got, want = L.infer(p, n), brute_infer(p.T.tolist(), n.tolist())
        assert {i for i, x in enumerate(got) if x > 0} == set(want)
        assert all(abs(got[i] - x) < 0.03 for i, x in want.items())


def test_whole_table_against_loops(spark, sf_dir):
    """Predictions of the query by loops over trigrams: counts, likelihoods and the mixture."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    learn = [r for r in docs if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    counts = {}
    for r in learn:
        counts.setdefault(r.lang, Counter()).update(L.trigrams(r.text).tolist())
    names = sorted(counts)
    like = lambda x, g: (counts[x][g] + L.SMOOTHING) / (counts[x].total() + L.SMOOTHING * L.GRAMS)
    got = {r.doc_id: r for r in L.op6_language_id(spark, sf_dir).collect()}
    checked = 0
    for r in docs:
        own = Counter(L.trigrams(r.text).tolist())
        if not own:
            assert got[r.doc_id].lang_pred == "und" and got[r.doc_id].score == 0
        elif len(own) < 150:
            want = brute_infer([[like(x, g) for g in own] for x in names], list(own.values()))
            top = max(want, key=want.get)
            assert got[r.doc_id].lang_pred == names[top] and abs(got[r.doc_id].score - want[top]) < 0.03
            checked += 1
        else:
            single = max(names, key=lambda x: sum(n * math.log(like(x, g)) for g, n in own.items()))
            assert got[r.doc_id].lang_pred == single or got[r.doc_id].score < 0.9
    assert checked > 10


def test_letters_decide(spark, documents):
    model = L.fit(documents([(i, "the cat and the dog", "en") for i in range(9)]))
    texts = ["\u0301\u0308", "\u302a\u302b", "12 \u0301 !", "\U000e0100", "a\u0301", "中", "ʰ", "\u0e33"]
    rows = {r.doc_id: r for r in L.identify(documents(list(enumerate(texts))).selectExpr("*", "1 AS Score", "2 AS MIXTURE"), model).collect()}
    for i, t in enumerate(texts):
        assert (rows[i].lang_pred == "und") == (not any(unicodedata.category(c)[0] == "L" for c in t)), repr(t)
    assert [c.lower() for c in rows[0].asDict()].count("score") == 1


def test_trigrams():
    assert len(L.trigrams("ab")) == 2 and len(L.trigrams("a1b")) == 2 and len(L.trigrams("")) == len(L.trigrams(None)) == len(L.trigrams("12 ?!")) == 0
    assert L.trigrams("ÀB c").tolist() == L.trigrams("àb C").tolist()
    long = "abc def " * 4000
    u, n = L.counted(long)
    assert dict(zip(u.tolist(), n.tolist(), strict=True)) == dict(zip(*(x.tolist() for x in np.unique(L.trigrams(long), return_counts=True)), strict=True))


def test_mixed_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = L.fit(docs)
    text = {x: " ".join(r.text for r in docs.filter(f"lang = '{x}'").limit(6).collect())[:3000] for x in ("en", "de")}
    name, score, mix, _ = model.predict(text["en"] + " " + text["de"])
    assert {m for m, _ in mix} >= {"en", "de"} and 0.35 < score < 0.65 and abs(sum(s for _, s in mix) - 1) < 1e-3
    assert model.predict(text["en"])[0] == "en" and model.predict("123 !!")[0] == model.predict(None)[0] == "und"


def test_held_out_accuracy(spark, sf_dir):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = L.op6_language_id(spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows) and len(rows) == len(lang)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.95


def test_labels_and_sources_are_no_inputs(spark, documents):
    rows = [(i, "the cat and the dog " * 3 if i % 2 else "der hund und die katze " * 3, "en" if i % 2 else "de") for i in range(60)]
    model = L.fit(documents(rows))
    first = L.identify(documents([(1, "the dog", None)]), model).first()
    other = L.identify(documents([(99, "the dog", "de", "zz")]), model).first()
    assert (first.lang_pred, first.score) == (other.lang_pred, other.score) and first.lang_pred == "en"


def test_awkward_rows(spark, documents, awkward):
    docs = documents(awkward).selectExpr("*", "1 AS score", "2 AS n", "3 AS gram")
    model = L.fit(docs)
    rows = L.identify(docs, model).collect()
    assert len(rows) == len(awkward) and {r.lang_pred for r in rows} <= {"en", "und"}
    assert all((r.lang_pred == "und") == (r.doc_id in (1, 2, 3, 8) or r.text is None) for r in rows)
    assert L.identify(docs, L.Model({})).filter("lang_pred <> 'und'").count() == 0
    assert L.fit(docs.limit(0)).languages == [] and L.filter_languages(docs.limit(0)).columns == docs.columns
    kept = L.filter_languages(docs)
    assert kept.columns == docs.columns and {r.score for r in kept.collect()} == {1}


def test_no_text_with_letters_goes(spark, documents, sf_dir):
    rows = [(i, f"some words of text number {i}", None) for i in range(20)] + [(90, "123 --- !", None), (91, None, None)]
    assert {r.doc_id for r in L.filter_languages(documents(rows)).collect()} == set(range(20))
    made = {"a": "abcd", "b": "ijkl", "c": "qrst", "d": "vwxy"}
    rng = random.Random(6)
    text = lambda letters: " ".join("".join(rng.choices(letters, k=6)) for _ in range(400))
    rows = [(100 * k + i, text(letters), lang) for k, (lang, letters) in enumerate(made.items()) for i in range(12)]
    docs = documents([*rows, (999, "\n".join(text(x) for x in made.values()), None)])
    assert L.identify(docs, L.fit(docs)).filter("doc_id = 999").first().score < L.LEAST_EXPLAINED
    assert {r.doc_id for r in L.filter_languages(docs).collect()} == {r[0] for r in rows} | {999}


def test_foreign_scripts_and_noise_go_and_mixtures_stay(spark, sf_dir, documents):
    r = random.Random(3)
    learned = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("lang is not null and length(text) > 200")
    rows = [tuple(x) for x in learned.select(F.col("doc_id").cast("long"), "text", "lang", "source").collect()]
    by = {}
    for _, t, lang, _ in rows:
        by.setdefault(lang, []).append(t)
    some = [by[k][0][:400] for k in sorted(by)]
    letters, base64 = "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    bad = ["Это обычный русский текст о погоде и природе. " * 5, "Αυτό είναι ένα απλό κείμενο στα ελληνικά για τον καιρό. " * 5, "这是一个关于天气和自然的普通中文文本" * 9, "".join(r.choices(letters, k=500)), "".join(r.choices(base64, k=900)), " ".join("".join(r.choices(letters, k=5)) for _ in range(90))]
    good = [a + " " + b for a, b in zip(some, some[1:], strict=False)] + [" ".join(some)]
    docs = documents([*rows, *((-1 - k, t, None, "x") for k, t in enumerate(bad)), *((-100 - k, t, None, "x") for k, t in enumerate(good))])
    kept = {x.doc_id for x in L.filter_languages(docs).collect()}
    assert not kept & {-1 - k for k in range(len(bad))}
    assert {-100 - k for k in range(len(good))} <= kept and {x[0] for x in rows} <= kept
    half = docs.unionByName(documents([(-200, some[0] + " " + bad[0] + bad[1], None, "x")]))
    assert [-200 in {x.doc_id for x in L.filter_languages(half, least).select("doc_id").collect()} for least in (0.2, 0.95)] == [True, False]
    assert L.filter_languages(docs, 0.0).count() == len(rows) + len(bad) + len(good)
