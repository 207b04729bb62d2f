"""Spelling variants against loops over all pairs of words; bands, chains of forms, odd letters, empty tables."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from hypothesis import assume, given
from hypothesis import strategies as st

from lodestone.llm import spelling

LETTERS = "abcdefghijklmnopqrstuvwxyzÀÖ×ßéÿ"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows, length=7):
    n = Counter()
    for i, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = "".join(c.lower() if "A" <= c <= "Z" else c for c in r)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            if h % 31 == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            if len(r) >= length:
                n[r] += 1
    return n


def loops(rows):
    n = {w: k for w, k in counted(rows).items() if k >= 2}
    out, forms = {}, {}
    for w in n:
        by = [x for x in n if near(w, x)]
        best = min(by, key=lambda x: (-n[x], x), default=None)
        forms[w] = best if best and n[best] >= 10 * n[w] else None
        out[w] = (n[w], len(by), forms[w], n[forms[w]] if forms[w] else None)
    roots = {}
    for w in n:
        roots[w] = w
        while forms[roots[w]]:
            roots[w] = forms[roots[w]]
    return {w: (*x, roots[w]) for w, x in out.items()}


def got(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.spelling_forms(df).collect()}


def corpus(seed=5, n=300):
    r = random.Random(seed)
    stems = ["".join(r.choices(LETTERS, k=r.randrange(7, 12))) for _ in range(25)]
    words = stems * 40
    for s in stems:
        for _ in range(30):
            i, c = r.randrange(len(s)), r.choice(LETTERS)
            x = r.choice([s[:i] + c + s[i + 1 :], s[:i] + s[i + 1 :], s[:i] + c + s[i:]])
            words += [x] * r.choice((1, 2, 3))
    r.shuffle(words)
    return [(i, " 12-".join(w.upper() if i % 5 == 0 and w.isascii() else w for w in words[i::n])) for i in range(n)]


def test_against_loops(documents, awkward):
    rows = corpus() + [r[:2] for r in awkward]
    want = loops(rows)
    assert got(documents(rows)) == want
    assert sum(x[2] is not None for x in want.values()) > 50


def test_chains(documents):
    text = " ".join(["variants"] * 5_000 + ["variantz"] * 400 + ["varianzz"] * 30 + ["variazzz"] * 2)
    rows = [(i, text) for i in range(3)]
    want = loops(rows)
    assert got(documents(rows)) == want
    assert want["variazzz"][4] == "variants"


def test_ties_go_to_the_smallest(documents):
    rows = [(3, "aaaaaaab " * 50 + "aaaaaaac " * 50 + "aaaaaaad " * 2)]
    assert got(documents(rows)) == loops(rows)


def test_null_and_empty(documents, spark):
    assert got(documents([])) == {}
    assert got(documents([(1, None), (None, "Abcdefgh abcdefgh")])) == loops([(1, None), (None, "Abcdefgh abcdefgh")])
    clash = spark.createDataFrame([(1, "abcdefghi " * 3, 1, "x")], "doc_id int, text string, n int, word string")
    assert got(clash) == loops([(1, "abcdefghi " * 3)])


def test_common_halves(spark):
    """Words that share bands and halves by the thousand give each pair once."""
    r = random.Random(2)
    words = list({"commonpart" + "".join(r.choices("abc", k=5)) for _ in range(200)} | {"".join(r.choices("abc", k=4)) + "commonpart" for _ in range(60)})
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    pairs = [tuple(sorted((p.a, p.b))) for p in spelling.near_pairs(df).collect()]
    assert sorted(pairs) == sorted((a, b) for a in words for b in words if a < b and near(a, b))


@given(st.text(alphabet=LETTERS, min_size=7, max_size=14), st.integers(0, 13), st.sampled_from(LETTERS), st.sampled_from(["insert", "delete", "replace"]))
def test_some_band_stays(word, at, letter, kind):
    at %= len(word)
    other = {"insert": word[:at] + letter + word[at:], "delete": word[:at] + word[at + 1 :], "replace": word[:at] + letter + word[at + 1 :]}[kind]
    assume(other != word)

    def bands(w):
        out = [0, 0, 0]
        for c in w:
            k = ord(c) - 97 if ord(c) < 192 else ord(c) - 166
            out[k % 3] ^= 1 << k // 3
        return out

    equal = [a == b for a, b in zip(bands(word), bands(other), strict=True)]
    assert any(equal) if kind == "replace" else any(equal[:2])


def test_bands_are_those_of_the_loop(spark):
    words = ["abcdefg", "zzzzzzz", "ÀÿßÖ×÷é", "éaéaéab"]
    df = spark.createDataFrame([(w,) for w in words], "word string").select("word", *(spelling.band(spelling.F.col("word"), k).alias(f"b{k}") for k in range(3)))
    for r in df.collect():
        want = [0, 0, 0]
        for c in r.word:
            k = ord(c) - 97 if ord(c) < 192 else ord(c) - 166
            want[k % 3] ^= 1 << k // 3
        assert [r.b0, r.b1, r.b2] == want
