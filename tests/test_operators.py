"""Operators that SQL doesn't express, against brute force and invariants."""

from __future__ import annotations

import math
import random
from collections import Counter
from difflib import SequenceMatcher
from itertools import pairwise

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone import registry
from lodestone.functions.text import meaningful_py
from lodestone.operators import evidence as V
from lodestone.operators import near as N
from lodestone.operators import rank as R
from lodestone.operators import response as Q
from lodestone.operators import selection as W
from lodestone.sources import pages as G
from lodestone.streaming import state as Z


def brute_rank(question, texts):
    """The ranking formula by loops."""
    seq, docs = meaningful_py(question), [meaningful_py(t) for t in texts]
    terms, pairs = set(seq), set(pairwise(seq))
    df, avg = Counter(t for d in docs for t in set(d)), sum(map(len, docs)) / max(1, len(docs))
    out = []
    for text, d in zip(texts, docs, strict=True):
        s = sum(math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * d.count(t) * 2.2 / (d.count(t) + 1.2 * (0.25 + 0.75 * len(d) / max(1.0, avg))) for t in terms if t in d)
        gaps = [abs(i - j) for i, a in enumerate(d) for j, b in enumerate(d) if a in terms and b in terms and a < b]
        s += 1.5 * (question.lower() in text.lower()) + 1.1 * len(pairs & set(pairwise(d))) / max(1, len(pairs)) + 0.9 * (len(terms & set(d)) / max(1, len(terms))) ** 2
        out.append(s + (min(0.8, 1.6 / max(2, min(gaps))) if gaps else 0))
    top = max(out, default=1) or 1
    return [round(min(1.0, s / top), 4) for s in out]


def test_rank_against_loops(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "the", "of", "running", "boxes"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 25))) for _ in range(40)] + ["", "alpha beta gamma"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r.score for r in R.rank(df, {"q": "alpha beta gamma boxes"}, "id").collect()}
    want = brute_rank("alpha beta gamma boxes", texts)
    assert all(abs(got[i] - w) < 1.01e-4 for i, w in enumerate(want))


def test_rank_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "id long, text string")
    assert {r.id: r.score for r in R.rank(df, {"q": "alpha"}, "id").collect()} == {1: 0.0, 2: 0.0}
    assert R.rank(df.limit(0), {"q": "alpha"}, "id").count() == 0
    assert {r.id: r.score for r in R.rank(df, {"q": "the of"}, "id").collect()} == {1: 0.0, 2: 0.0}


def test_grouped_rank_is_ranking_each_group(spark):
    rows = [(g, i, t) for g in (1, 2) for i, t in enumerate(["alpha beta", "beta gamma " * g, "delta alpha " * 3])]
    df = spark.createDataFrame(rows, "g int, id long, text string")
    whole = {(r.g, r.id): r.score for r in R.rank(df, {"q": "alpha beta"}, "id", by=["g"]).collect()}
    for g in (1, 2):
        assert {k[1]: v for k, v in whole.items() if k[0] == g} == {r.id: r.score for r in R.rank(df.filter(F.col("g") == g), {"q": "alpha beta"}, "id").collect()}


def test_near_results():
    row = lambda pos, url, title, snippet, engines=("a",): {"pos": pos, "canonical_url": url, "domain": url.split("/")[2], "title": title, "snippet": snippet, "engines": list(engines), "search_score": 1 - pos / 10}
    long = "the very same text of a snippet with many words in it"
    got = V.merge_near(pd.DataFrame([row(0, "http://a.x/1", "One title here", long), row(1, "http://a.x/1", "Other", "s", "b"), row(2, "http://a.x/2", "zzz", long + "!"), row(3, "http://b.x/1", "zzz", long)]))
    assert got["pos"].tolist() == [0, 3] and got["engines"][0] == ["a", "b"] and got["snippet"][0] == long + "!"
    assert V.merge_near(pd.DataFrame([], columns=["pos", "canonical_url", "domain", "title", "snippet", "engines", "search_score"])).empty


def test_alike_is_the_ratio():
    rng = random.Random(5)
    for _ in range(300):
        a = "".join(rng.choices("abc ", k=rng.randint(0, 40)))
        b = "".join(c if rng.random() > 0.05 else "x" for c in a)
        assert N.alike(a, b, 0.9) == (SequenceMatcher(None, a, b).ratio() >= 0.9)


def picks(rows, limit, facets=(), question=None):
    base = {"text": "", "passage_score": 0.5, "source_score": 0.8, "quality": 0.9, "authority": False}
    return V.select_diverse(pd.DataFrame([base | {"pos": i} | r for i, r in enumerate(rows)]), limit, facets, question)["source_id"].tolist()


def test_selection():
    near = [{"source_id": "s1", "text": "alpha beta gamma", "passage_score": 1.0}, {"source_id": "s1", "text": "alpha beta gamma", "passage_score": 0.99}, {"source_id": "s2", "text": "delta eps", "passage_score": 0.9}]
    assert set(picks(near, 2)) == {"s1", "s2"}
    assert picks([{"source_id": f"s{i % 2}", "text": f"w{i}"} for i in range(9)], 9) == ["s0", "s1", "s0", "s1"]
    assert picks([{"source_id": "s1", "source_score": 0.1}], 3) == []
    capped = [{"source_id": "big", "text": t} for t in ("alpha beta", "gamma delta", "eps zeta")] + [{"source_id": "alt", "text": "other words"}]
    assert Counter(picks(capped, 3, facets=["alpha beta", "gamma delta", "eps zeta"])) == {"big": 2, "alt": 1}
    assert picks([{"source_id": "a", "text": "alpha beta"}, {"source_id": "b", "text": "alpha beta", "authority": True, "passage_score": 0.1}], 2, question="alpha beta")[0] == "b"


@pytest.mark.parametrize("candidates", [50, 1])
def test_selection_of_large_groups(spark, candidates):
    """As the loop over all rows, however large a group; rows of low base score can be the only ones for a facet or authority."""
    rng = random.Random(31)
    rows = []
    for g in ("a", "b", None):
        for pos in range(700):
            text = " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"], k=rng.randint(2, 5)))
            rows.append((g, pos, f"s{rng.randrange(6)}", text, rng.randrange(40, 80) / 100, 0.8, 0.9, False))
        rows.append((g, 700, "s1", "alpha zeta", 0.0, 0.2, 0.0, False))
        rows.append((g, 701, "s2", "theta", 0.0, 0.2, 0.0, True))
    names = ["q", "pos", "source_id", "text", "passage_score", "source_score", "quality", "authority"]
    df = spark.createDataFrame(rows, "q string, pos long, source_id string, text string, passage_score double, source_score double, quality double, authority boolean")
    got = {(r.q, r.position): r.pos for r in V.diverse(df, ["q"], 9, ["zeta", "alpha beta"], "theta", candidates).collect()}
    for g in ("a", "b", None):
        want = V.select_diverse(pd.DataFrame([r for r in rows if r[0] == g], columns=names), 9, ["zeta", "alpha beta"], "theta")["pos"].tolist()
        assert [got[g, k + 1] for k in range(9)] == want and want[:2] == [701, 700]
    assert len(got) == 27


def test_fetch_selection():
    row = lambda key, score, kind="web_page", preferred=None: {"key": key, "domain": key, "kind": kind, "preliminary": score, "preferred": preferred, "scores": [score], "fits": [True]}
    rows = [row("first", 1.0), row("third", 0.8), row("docs", 0.01, "official_documentation")]
    assert [r["key"] for r in W.choose(rows, 1)] == ["first"]
    assert [r["key"] for r in W.choose(rows, 2)] == ["first", "third"]
    assert [r["key"] for r in W.choose([*rows, row("liked", 0.3, preferred=0)], 2)][0] == "liked"
    assert W.choose([], 3) == [] and W.choose(rows, 0) == []


def test_coverage_and_contradictions(spark):
    topics = spark.createDataFrame([(1, 0, "MCP transport"), (1, 1, "Docker DNS isolation")], "q int, pos int, topic string")
    ev = spark.createDataFrame([(1, "e1", 0, "MCP uses HTTP transport", "low"), (1, "e2", 1, "Docker DNS isolation", "high")], "q int, evidence_id string, pos int, text string, risk string")
    got = {r.topic: r.covered for r in V.topic_coverage(topics, ev, ["q"]).collect()}
    assert got == {"MCP transport": True, "Docker DNS isolation": False}
    two = spark.createDataFrame([(1, "e1", 0, "Product speed result is 10 ms."), (1, "e2", 1, "Product speed result is 20 ms."), (1, "e3", 2, "Other words stand here 5")], "q int, evidence_id string, pos int, text string")
    rows = V.contradictions(two, ["q"]).collect()
    assert [(r.evidence_ids, r.description) for r in rows] == [(["e1", "e2"], "Conflicting numeric or version values found: 10, 20")]


def test_chunks():
    text = "First Heading\n\nOne paragraph here.\n\nSecond Heading\n\nAnother paragraph there."
    got = G.chunks(text)
    assert [h for h, _, _ in got] == ["First Heading", "Second Heading"]
    long = "\r\n\r\n".join(" ".join(f"Word{i} number {j}." for j in range(12)) for i in range(3))
    parts = G.chunks(long, 45, 72)
    assert len(parts) >= 3 and all(e - s <= 72 for _, s, e in parts)
    assert " ".join(long[s:e] for _, s, e in parts).split() == long.split()
    assert G.chunks("") == G.chunks(" \n\n ") == []
    assert G.chunks("x" * 5000 + ".") == [(None, 0, 5001)]


def test_chunks_of_odd_texts_are_whole_and_exact(spark, tmp_path):
    """As the query's SQL says: white space that only Python knows, blank and null texts, ids that are null or come twice."""
    long = "Some words stand here.\u00a0" * 200
    texts = [None, "", " \n\t ", "\u3000\x1f", "\u00a0lead", "tail\u2003", "a\x85\n\nb", long, long.replace("\u00a0", "\x1c"), long.replace("\u00a0", "\u2028 "), "\x0b a \x0c", "\u200b zero width"]
    rows = [*enumerate(texts), (3, "One text."), (3, "Another text, of the same id."), (4, "\u00a0lead"), (None, "No id."), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "t" / "documents.parquet"))
    got = registry.queries()["chunk_invariants"](spark, str(tmp_path / "t")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in rows)
    assert [r for r in got if r.whole_and_exact is not True] == []


def test_shown_text():
    html = "<html><head><title>t</title></head><body><nav>menu</nav><!-- c --><article><p>" + "Good text. " * 30 + "</p><div style='display: none'>bad</div><div class='ads'>ad</div><p hidden>h</p>A &amp; B<br>C</article><footer>f</footer></body></html>"
    text, how = G.shown_text(html)
    assert how == "article" and "bad" not in text and "menu" not in text and "A & B\nC" in text and "ad" not in text.split()
    assert G.shown_text(None) == ("", "readable")


def test_shown_text_of_cut_pages_is_as_in_sql(spark, tmp_path):
    good, head = "Good text. " * 30, "<html><head><title>t</title></head><body>"
    pages = [
        head + f"<article><h1>A &amp;&amp; B&amp</h1><p>{good}&#39;x&#39; a&b &amp</p></article></body></html>",  # a reference cut before its semicolon
        head + f"<div>{good}</div><article><p><b>short<br></article><footer>f</footer>",  # body is never closed
        head + f"<article><p>{good}",
        head + f"<article>{good}one</article><article>{good}two</article></body></html>",
        head + f"<article>short</article><p>{good}</body></html>",
    ]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(str(tmp_path / "t" / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/t/pages.parquet/*.parquet')")
    want = sorted(con.sql(registry.oracle_sql()["page_text"]).fetchall())
    assert [r[2] for r in want] == ["article", "readable", "readable", "article", "body"]
    assert sorted(tuple(r) for r in registry.queries()["page_text"](spark, str(tmp_path / "t")).collect()) == want


def package(n=8, size=2000):
    return {
        "question": "alpha beta?", "coverage": {"status": "strong", "score": 0.9, "covered_topics": ["alpha", "beta"], "missing_topics": []},
        "sources": [{"source_id": f"src_{i:03d}", "title": f"T{i}", "url": f"https://x.org/{i}", "source_type": "web_page"} for i in range(n)],
        "evidence": [{"citation": f"[src_{i:03d}, ev_{i:03d}]", "source_id": f"src_{i:03d}", "text": "Alpha beta gamma delta. " * (size // 24)} for i in range(n)],
        "search_snippets": [{"citation": f"[search_{i:03d}]", "role": "exact" if i < 10 else "expanded", "title": "t" * 90, "url": f"https://y.org/{i}", "text": "words " * 80, "relevance": 0.5} for i in range(14)],
        "contradictions": [], "failures": [{"stage": "fetch", "error": "x", "count": 12}], "warnings": ["w", "w"], "unresolved_questions": [],
    }


@pytest.mark.parametrize("budget", [4000, 8000, 14000])
def test_responses_fit(budget):
    got = Q.compact_response(package(), budget)
    assert Q.chars(got) <= budget
    assert sum(s["role"] == "exact" for s in got["search_snippets"]) == 10 and len(got["evidence"]) >= (4 if budget > 4000 else 2)


def test_extracts():
    text = "Nothing here at all. " * 20 + "Alpha is first. " + "Filler goes on. " * 20 + "Beta is second. " + "More of it. " * 20
    got = Q.extract(text, 200, "alpha beta")
    assert "Alpha is first." in got and "Beta is second." in got and len(got) <= 200
    assert Q.extract("short", 200, "alpha") == "short"
    assert "alpha" in Q.extract("x " * 300 + "alpha " + "y " * 300, 60, "alpha")


def test_breaker(spark):
    b = Z.Breaker()
    assert [b.admit(t, True) for t in (0, 1, 2)] == [True] * 3 and not b.admit(30, False) and b.admit(62, False)


def test_retention_of_nothing(spark):
    e = spark.createDataFrame([(1, 1)], "record_id int, x int").withColumns({"expires_at": F.lit("2030-01-01").cast("timestamp_ntz"), "created_at": F.lit("2020-01-01").cast("timestamp_ntz")})
    assert all(df.count() == 0 for df in Z.sweep(e, e, e, e, F.lit("2020-01-02").cast("timestamp_ntz"), 0).values())
    kept = Z.sweep(e, e, e, e.select("record_id"), F.lit("2020-01-02").cast("timestamp_ntz"), 7)
    assert {k: df.count() for k, df in kept.items()} == {"cache": 1, "requests": 1, "evidence": 1, "passages": 1}


def test_streams(spark, sf_dir, tmp_path):
    """The breaker and windows over a stream give what they give over the table."""
    src = tmp_path / "in"
    rows = spark.createDataFrame([(f"d{i % 2}", float(i), i, i % 5 != 0) for i in range(60)], "domain string, at double, id long, transient boolean")
    rows.repartition(1).write.parquet(str(src))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = Z.breaker_stream(spark.readStream.schema(rows.schema).parquet(str(src)), "domain")
    q = stream.writeStream.format("memory").queryName("breaker").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    got = {r.id: r.admitted for r in spark.sql("SELECT * FROM breaker").collect()}
    assert got == {r.id: r.admitted for r in Z.breaker(rows, "domain").collect()}

    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(1).write.parquet(str(tmp_path / "ev"))
    live = Z.windowed(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev")), "ts", ["event_type"], "1 day", lateness="1 hour")
    q = live.select(F.col("w.start").alias("s"), "event_type", "n").writeStream.format("memory").queryName("wins").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(120)
    want = {(r.w.start, r.event_type): r.n for r in Z.windowed(events, "ts", ["event_type"], "1 day").collect()}
    assert {(r.s, r.event_type): r.n for r in spark.sql("SELECT * FROM wins").collect()} == want


def test_near_results_of_whole_questions(spark, sf_dir):
    """The query against plain loops over all earlier kept rows, ratios taken in full; URLs under two domains merge as well."""
    from lodestone.operators import results as S
    from lodestone.queries.results import page_results

    rows = S.normalize(page_results(spark, sf_dir).drop("marked")).withColumn("question", F.floor(F.col("pos") / 40))
    alias = rows.filter("pos % 9 = 0").withColumns({"pos": F.col("pos") + 10_000, "domain": F.lit("mirror.example"), "title": F.concat("title", F.lit(" x")), "engines": F.array(F.lit("m"))})
    again = rows.filter("pos % 7 = 0").withColumns({"pos": F.col("pos") + 20_000, "canonical_url": F.concat("canonical_url", F.lit("/copy")), "snippet": F.concat("snippet", F.lit("!"))})
    rows = rows.unionByName(alias).unionByName(again)
    want = []
    for q in {r.question for r in rows.select("question").distinct().collect()}:
        kept = []
        for r in rows.filter(F.col("question") == q).orderBy("pos").collect():
            r = r.asDict()
            for k in kept:
                close = lambda f, least, r=r, k=k: SequenceMatcher(None, r[f].casefold(), k[f].casefold()).ratio() >= least
                if r["canonical_url"] == k["canonical_url"] or (r["domain"] == k["domain"] and (close("title", 0.93) or (r["snippet"] and k["snippet"] and close("snippet", 0.94)))):
                    k["engines"] = sorted({*k["engines"], *r["engines"]})
                    k["search_score"] = max(k["search_score"], r["search_score"])
                    k["snippet"] = r["snippet"] if len(r["snippet"]) > len(k["snippet"]) else k["snippet"]
                    break
            else:
                kept.append(r | {"engines": sorted(set(r["engines"]))})
        want += [(q, k["pos"], k["snippet"], k["engines"], k["search_score"]) for k in kept]
    got = [(r.question, r.pos, r.snippet, r.engines, r.search_score) for r in N.near_results(rows, ["question"]).collect()]
    assert sorted(got) == sorted(want) and len(got) < rows.count() - 5


@pytest.mark.parametrize("limit", [1, 3, 8])
def test_fetch_order_of_large_groups(spark, limit):
    """The rows that a task gets choose as the whole group would, whatever its size."""
    rng = random.Random(limit)
    rows = []
    for g in range(6):
        for i in range(rng.choice([2, 30, 900])):
            preferred = rng.choice([None] * 40 + [float(rng.randrange(50))])
            rows.append((g, f"k{g}-{i}", i, f"d{rng.randrange(1 + 400 * (g % 2))}", rng.choice(["web_page"] * 9 + ["publication", "official_documentation"]), rng.randrange(100) / 100, preferred, [rng.randrange(50) / 50 for _ in range(3)], [rng.random() < 0.2 for _ in range(3)]))
    names = ["g", "key", "pos", "domain", "kind", "preliminary", "preferred", "scores", "fits"]
    df = spark.createDataFrame(rows, "g int, key string, pos int, domain string, kind string, preliminary double, preferred double, scores array<double>, fits array<boolean>")
    got = {(r.g, r.position): r.key for r in W.fetch_order(df, ["g"], limit, 3).collect()}
    want = {}
    for g in range(6):
        own = sorted((dict(zip(names, r, strict=True)) for r in rows if r[0] == g), key=lambda r: (-r["preliminary"], r["pos"]))
        want |= {(g, k + 1): r["key"] for k, r in enumerate(W.choose(own, limit))}
    assert got == want


def test_no_task_of_the_fetch_order_gets_a_whole_group(spark):
    """Each order's first rows are found before groups meet: one limit before the shuffle and one after, for the best, each facet and the preferred."""
    df = spark.createDataFrame([], "g int, key string, pos int, domain string, kind string, preliminary double, preferred double, scores array<double>, fits array<boolean>")
    df = df.unionByName(spark.range(9).selectExpr("1 AS g", "string(id) AS key", "int(id) AS pos", "'d' AS domain", "'k' AS kind", "double(id) AS preliminary", "double(id) AS preferred", "array(0.1D, 0.2D, 0.3D) AS scores", "array(true, true, true) AS fits"))
    plan = W.fetch_order(df, ["g"], 4, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 * (1 + 3 + 1)


def test_extracts_of_whole_texts(spark, sf_dir):
    """Extracts are made of whole sentences of the text in their order, within the limit, and name as many terms as any one sentence that fits."""
    question = "erinant thonor ering ththe thanedble attion"
    terms = set(meaningful_py(question))
    seen = 0
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        text = " ".join((r.text or "").split())
        got = Q.extract(r.text or "", 320, question)
        assert len(got) <= 320
        sentences = [s for s in Q.SPLIT.split(text) if s.strip()]
        fits = [s for s in sentences if terms & set(meaningful_py(s)) and len(s) <= 300]
        pieces = [p for p in got.strip("…").split(" … ")]
        if len(text) > 320 and all(p in sentences for p in pieces):
            rest = iter(sentences)
            assert all(p in rest for p in pieces)  # a sentence can come twice
            assert len(terms & set(meaningful_py(got))) >= max((len(terms & set(meaningful_py(s))) for s in fits), default=0)
            seen += 1
        elif len(text) <= 320:
            assert got == text
        else:
            assert got.strip("…").strip() in text
    assert seen > 10


@pytest.mark.parametrize("budget", [4000, 5000, 9000])
def test_responses_of_whole_conversations(spark, sf_dir, budget):
    """Every response is within its budget and says nothing that its package doesn't: labels, URLs, roles and order, and texts cut from the package's."""
    import json

    from lodestone.queries.state import _packages

    for r in Q.responses(_packages(spark, sf_dir), "conv_id", "package", budget).join(_packages(spark, sf_dir), "conv_id").collect():
        got, given = json.loads(r.response), json.loads(r.package)
        assert r.size == len(r.response) and (r.size <= budget or got["response_info"].get("budget_exceeded_for_exact_urls"))
        flat = lambda x: " ".join(x.split())
        for kind in ("evidence", "search_snippets"):
            whole = {x["citation"]: x for x in given[kind]}
            order = [list(whole).index(x["citation"]) for x in got[kind]]
            if kind == "evidence":
                assert order == sorted(order)
            for x in got[kind]:
                text = flat(whole[x["citation"]]["text"])
                for piece in x.get("text", "").strip("…").split(" … "):
                    assert piece.strip("… ") in text
                assert all(x[f] == whole[x["citation"]][f] for f in ("url", "role", "source_id") if f in x)
        assert {s["source_id"] for s in got["sources"]} <= {e["source_id"] for e in got["evidence"]} <= {s["source_id"] for s in given["sources"]}
        assert got["response_info"]["omitted_evidence"] == len(given["evidence"]) - len(got["evidence"])
        roles = [x["role"] for x in got["search_snippets"]]
        assert roles == sorted(roles, key=["exact", "expanded"].index) and len(set(got["warnings"])) == len(got["warnings"])
