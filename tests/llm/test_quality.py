from __future__ import annotations

import itertools
import random
import re

import numpy as np

from lodestone.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    """The contract's counts by its words."""
    text = text or ""
    words = WORD.findall(text)
    seen, dup = [], 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.append(line)
    win = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    rep = {i + d for i, w in enumerate(win) if win.count(w) > 1 for d in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(rep)


def test_counts():
    rng = random.Random(14)
    for _ in range(400):
        text = "".join(rng.choices(["a", "b", "cé", "😀", " ", "\n", "#", "|", "\t", "\x0b", "\x1c", "\u00a0", "a b c ", "\r"], k=rng.randint(0, 60)))
        assert Q.measure(text)[0] == brute(text), repr(text)
    assert Q.measure(None)[0] == (0, 0, 0, 0, 0)


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(15)
    for n in range(1, 8):
        s, m = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))
        value = lambda y, s=s, m=m: sum(s[t, y[t]] for t in range(len(y))) + sum(m[a, b] for a, b in itertools.pairwise(y))
        assert abs(value(Q.viterbi(s, m)) - max(value(y) for y in itertools.product((0, 1), repeat=n))) < 1e-9


def test_training_follows_the_likelihood():
    rng = np.random.default_rng(16)
    data = []
    for _ in range(60):
        y = np.repeat(rng.integers(0, 2, 4), 5)
        x = rng.normal(size=(20, Q.FEATURES)) * 0.5
        x[:, 0], x[:, 1] = 1, y + rng.normal(size=20) * 0.3
        data.append((x, y))
    w, m = Q.train(data, rounds=200)
    assert m[0, 0] + m[1, 1] > m[0, 1] + m[1, 0]
    assert np.mean([np.mean(Q.viterbi(x @ w, m) == y) for x, y in data]) > 0.97

    def loglik(w, m):
        total = 0.0
        for x, y in data[:5]:
            s = x @ w
            a = s[0]
            for t in range(1, len(y)):
                a = np.logaddexp(a[0] + m[0], a[1] + m[1]) + s[t]
            total += s[np.arange(len(y)), y].sum() + m[y[:-1], y[1:]].sum() - np.logaddexp(*a)
        return total

    assert loglik(w, m) > loglik(np.zeros_like(w), np.zeros_like(m)) + 10


def test_clean_documents_stay_and_junk_goes(spark, sf_dir):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = Q.op10_quality_rules(spark, sf_dir).collect()
    judged = [(r, labels[r.doc_id].quality) for r in rows if r.doc_id in labels and not r.base_failed]
    assert all(not r.kept for r in rows if r.base_failed)
    assert sum(r.kept == bool(q) for r, q in judged) / len(judged) > 0.95


JUNK = ("***", "%%%", "$$$", "###", "&&&", " | ", "!!")


def is_junk(line):
    words = line.split()
    return any(x in line for x in JUNK) or (len(words) > 5 and sum(a == b for a, b in itertools.pairwise(words)) > 0.5 * len(words))


def test_lines_of_held_out_documents(spark):
    """Trained on some documents' labels, the field tells the lines of others apart, in mixed documents too."""
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.doc_id in labels and (r.text or "").strip()]
    train, held = [d for d in docs if d[0] % 3], [d for d in docs if d[0] % 3 == 0]
    w, m = Q.learn([(Q.measure(t)[1], labels[i] > 0) for i, t in train])
    lines = lambda t: [x for x in t.split("\n") if WORD.search(x)]
    marked = [(is_junk(x), bool(y)) for _, t in held for x, y in zip(lines(t), Q.viterbi(Q.measure(t)[1] @ w, m), strict=True)]
    assert sum(j for j, _ in marked) > 50
    assert np.mean([not y for j, y in marked if j]) > 0.9 and np.mean([y for j, y in marked if not j]) > 0.97
    rng = random.Random(17)
    good, bad = ([x for i, t in held for x in lines(t) if is_junk(x) == j and labels[i] == 1 - j] for j in (0, 1))
    right = []
    for _ in range(60):
        parts = [(rng.sample(good, 4), 1), (rng.sample(bad, 3), 0), (rng.sample(good, 3), 1)]
        text = "\n".join(x for p, _ in parts for x in p)
        want = [y for p, y in parts for _ in p]
        right += [a == b for a, b in zip(Q.viterbi(Q.measure(text)[1] @ w, m).tolist(), want, strict=True)]
    assert np.mean(right) > 0.93


def test_kept_against_loops(spark, documents, sf_dir):
    """Whole rows of the operator against all paths of labels, shares and rules done by loops."""
    rng = random.Random(18)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    line = lambda: " ".join(word() + rng.choice(["", "", "***", "!!"]) for _ in range(rng.randint(1, 25)))
    rows = [(i, "\n".join(rng.choice([line, lambda: " ".join(word() for _ in range(12))])() for _ in range(rng.randint(1, 8)))) for i in range(80)]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    w, m = Q.learn(Q.sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    kept = 0
    for r in Q.judge(documents(rows), w, m).collect():
        text = rows[r.doc_id][1]
        n, *_, repeated = brute(text)
        f, sizes = Q.measure(text)[1], [len(x.split()) for x in text.split("\n")]
        value = lambda y, s=f @ w: sum(s[t, y[t]] for t in range(len(y))) + sum(m[a, b] for a, b in itertools.pairwise(y))
        best = max(itertools.product((0, 1), repeat=len(f)), key=value)
        share = sum(k for k, y in zip(sizes, best, strict=True) if y) / n
        assert abs(r.content_share - share) < 1e-12
        assert r.base_failed == (n < 50 or 100 * repeated > 50 * n) and r.kept == (not r.base_failed and share >= Q.CONTENT_SHARE)
        kept += r.kept
    assert 5 < kept < 75


def test_the_sample_is_bounded(spark, documents):
    long = "\n".join(f"line {i} of many words that differ {i * i}" for i in range(5_000))
    docs = documents([(i, long) for i in range(6)] + [(0, long)] * 20)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(6)], "doc_id long, quality int, toxic int")
    bags = Q.sample(docs, labels, most=4, lines=32)
    assert len(bags) == 4 and all(f.shape == (32, Q.FEATURES) for f, _ in bags)


def test_awkward_rows(spark, documents, awkward):
    docs = documents(awkward).selectExpr("*", "1 AS kept", "2 AS quality", "3 AS n_words")
    labels = spark.createDataFrame([(4, 1, 0), (None, 0, 0), (5, None, 0), (6, 0, 1), (6, 1, 1)], "doc_id long, quality int, toxic int")
    rows = Q.judge(docs, *Q.learn(Q.sample(docs, labels))).collect()
    assert len(rows) == len(awkward) and all(r.base_failed and not r.kept for r in rows if r.n_words < 50)
    assert next(r for r in rows if r.doc_id == 6).base_failed  # one phrase over and over
    w, m = Q.learn(Q.sample(docs, labels.limit(0)))
    assert Q.judge(docs, w, m).count() == len(awkward) and Q.judge(docs.limit(0), w, m).count() == 0
