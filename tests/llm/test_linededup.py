from __future__ import annotations

import random

from lodestone.llm import linededup as L


def brute(rows, k=3):
    """Texts by loops: all windows in order, the first of each stays."""
    seen, out = set(), {}
    for i, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0])):
        lines = (text or "").split("\n")
        full = [j for j, x in enumerate(lines) if x.encode().strip()]
        gone = set()
        for p in range(len(full) - k + 1):
            w = tuple(lines[full[p + d]] for d in range(k))
            if w in seen:
                gone |= {full[p + d] for d in range(k)}
            seen.add(w)
        out[i] = None if text is None else "\n".join(x for j, x in enumerate(lines) if j not in gone)
    return out


def test_against_loops(spark, documents):
    rng = random.Random(4)
    rows = [(i, "\n".join(rng.choices(["alpha", "beta", "gamma", "", " ", "delta é"], weights=[6, 5, 4, 2, 1, 3], k=rng.randint(0, 12)))) for i in range(120)]
    got = {r.doc_id: r.text for r in L.dedup_lines(documents(rows)).collect()}
    assert got == brute(rows)


def test_passages_that_repeat_go_but_once(spark, documents):
    passage = "\n".join(f"line {i} of a long passage that many documents share" for i in range(8))
    rows = [(i, f"start {i}\n{passage}\nend {i}") for i in range(40)] + [(99, "its own\nlines\nonly\nhere")]
    got = {r.doc_id: r for r in L.dedup_lines(documents(rows)).collect()}
    assert got[0].text == rows[0][1] and got[99].text == rows[-1][1] and got[99].n_removed == 0
    assert all(got[i].text == f"start {i}\nend {i}" and got[i].n_removed == 8 for i in range(1, 40))


def test_hot_windows_are_salted(spark, documents, monkeypatch):
    rows = [(i, "a\nb\nc" if i % 3 else f"x{i}\ny\nz") for i in range(90)]
    plain = {r.doc_id: r.text for r in L.dedup_lines(documents(rows)).collect()}
    from lodestone.llm import common

    monkeypatch.setattr(L, "lookup_join", lambda *a, **k: common.lookup_join(*a, **(k | {"least": 5})))  # a key is hot from 6 rows
    assert {r.doc_id: r.text for r in L.dedup_lines(documents(rows)).collect()} == plain == brute(rows)


def test_awkward_rows(spark, documents, awkward):
    docs = documents(awkward).selectExpr("*", "1 AS pos", "2 AS n_lines", "3 AS starts", "4 AS high", "5 AS body", "6 AS _id", "7 AS _body", "8 AS _STARTS")
    rows = L.dedup_lines(docs).collect()
    assert len(rows) == len(awkward) and set(rows[0].asDict()) == {*docs.columns, "n_removed"}
    texts = [r.text for r in rows if r.doc_id == 5]
    assert sorted(texts) == ["", "", "the same id with another text"]  # both rows of the repeated document lose what document 4 has
    assert next(r.text for r in rows if r.doc_id == 1) is None and L.dedup_lines(docs.limit(0)).count() == 0
