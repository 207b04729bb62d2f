"""Tokens, passage ranking and its parts over documents and conversations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import index as I
from lodestone.operators import rank as R
from lodestone.plans.lineage import shared_folder
from lodestone.registry import register
from lodestone.sources.tables import table, texts

from . import duck as D

#: The questions that ranking queries ask.
QUESTIONS = {
    "q1": "Licensed under the Apache License, Version 2.0",
    "q2": "Released under the MIT License",
    "q3": "Which works are licensed under the GNU General Public License?",
    "q4": "All rights reserved",
    "q5": "The and attion to thanedble the, anea. Eriner thanea.",
    "q6": "Nicht aulich für sch erüver enau sch der.",
    "q7": "token password secret",
}
TOP = 10


def bm25_topk(spark, sf_dir):
    return R.top(R.rank(texts(spark, sf_dir, "documents", "doc_id", "text"), QUESTIONS, "doc_id"), TOP, "doc_id").select("question_id", "rank", "doc_id", "score")


def rank_sql(passages: str, key: str, questions: dict[str, str]) -> str:
    """SQL with scored(question_id, grp, key, raw, coverage, score) over passages(key, grp, text), each grp a corpus; terms and positions as rows."""
    return f"""
q AS (SELECT * FROM {D.values(list(questions.items()), 'v(question_id, body)')}),
qw AS (SELECT question_id, body, {D.meaningful('body')} AS w FROM q),
qt AS (SELECT question_id, unnest(list_distinct(w)) AS term FROM qw),
qb AS (SELECT question_id, unnest({D.bigrams('w')}) AS gram FROM qw),
p AS ({passages}),
pw AS (SELECT {key}, grp, {D.meaningful("coalesce(text, '')")} AS w FROM p),
pn AS (SELECT {key}, grp, len(w) AS n FROM pw),
tok AS (SELECT {key}, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS pos FROM pw),
st AS (SELECT grp, count(*) AS docs, avg(n) AS avg_n FROM pn GROUP BY grp),
tf AS (SELECT {key}, term, count(*) AS tf FROM tok GROUP BY ALL),
df AS (SELECT grp, term, count(*) AS df FROM tf JOIN pn USING ({key}) GROUP BY ALL),
bm AS (SELECT qt.question_id, tf.{key}, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / greatest(1.0, avg_n)))) AS s, count(*) AS hits
    FROM qt JOIN tf USING (term) JOIN pn ON pn.{key} = tf.{key} JOIN df ON df.term = tf.term AND df.grp = pn.grp JOIN st ON st.grp = pn.grp GROUP BY ALL),
nq AS (SELECT question_id, count(*) AS nt FROM qt GROUP BY question_id),
gap AS (SELECT question_id, {key}, min(CASE WHEN term <> before THEN pos - was END) AS gap FROM (SELECT qt.question_id, tok.{key}, tok.term, tok.pos,
    lag(tok.term) OVER (PARTITION BY qt.question_id, tok.{key} ORDER BY tok.pos) AS before, lag(tok.pos) OVER (PARTITION BY qt.question_id, tok.{key} ORDER BY tok.pos) AS was
    FROM qt JOIN tok USING (term)) GROUP BY ALL),
grams AS (SELECT {key}, unnest({D.bigrams('w')}) AS gram FROM pw),
nb AS (SELECT question_id, count(*) AS n FROM qb GROUP BY question_id),
big AS (SELECT qb.question_id, grams.{key}, count(*) / any_value(nb.n)::DOUBLE AS share FROM qb JOIN grams USING (gram) JOIN nb USING (question_id) GROUP BY ALL),
raws AS (SELECT q.question_id, p.grp, p.{key}, coalesce(hits, 0) / nt::DOUBLE AS coverage,
    coalesce(bm.s, 0) + CASE WHEN contains({D.casefold("coalesce(p.text, '')")}, {D.casefold('q.body')}) THEN 1.5 ELSE 0 END + 0.9 * pow(coalesce(hits, 0) / nt::DOUBLE, 2)
    + CASE WHEN gap IS NULL THEN 0 ELSE least(0.8, 1.6 / greatest(2, gap)) END + 1.1 * coalesce(share, 0) AS raw
    FROM q CROSS JOIN p JOIN nq USING (question_id) LEFT JOIN bm ON bm.question_id = q.question_id AND bm.{key} = p.{key}
    LEFT JOIN gap ON gap.question_id = q.question_id AND gap.{key} = p.{key} LEFT JOIN big ON big.question_id = q.question_id AND big.{key} = p.{key}),
scored AS (SELECT question_id, grp, {key}, coverage, raw, round(least(1.0, raw / (CASE WHEN max(raw) OVER (PARTITION BY question_id, grp) = 0 THEN 1.0 ELSE max(raw) OVER (PARTITION BY question_id, grp) END)), 4)::DOUBLE AS score FROM raws)"""


register("bm25_topk", ("T1", "T2", "T3", "T4", "T5", "R1", "R3", "W1", "W4", "A1"), bm25_topk, f"""
WITH {rank_sql("SELECT doc_id, 0 AS grp, text FROM documents", "doc_id", QUESTIONS)}
SELECT question_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= {TOP}""")


def index_topk(spark, sf_dir):
    """The index of all documents, written to the shared folder, then each question by its postings."""
    folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    I.build(texts(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", folder)
    index, out = I.Index(spark, folder), None
    for name, question in QUESTIONS.items():
        one = index.top(question, TOP, first=2).select(F.lit(name).alias("question_id"), "rank", F.col("key").alias("doc_id"), "score")
        out = one if out is None else out.unionByName(one)
    return out


register("index_topk", ("R1", "J1", "W1"), index_topk, f"""
WITH {rank_sql("SELECT doc_id, 0 AS grp, text FROM documents", "doc_id", QUESTIONS)}
SELECT question_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= {TOP}""")


def facet_rank(spark, sf_dir):
    return R.rank_facets(texts(spark, sf_dir, "documents", "doc_id", "text"), QUESTIONS, "doc_id")


register("facet_rank", ("R2", "J1"), facet_rank, f"""
WITH {rank_sql("SELECT doc_id, 0 AS grp, text FROM documents", "doc_id", QUESTIONS)},
f AS (SELECT doc_id, max(score * coverage) AS s FROM scored GROUP BY doc_id)
SELECT doc_id, round(least(1.0, s / (CASE WHEN max(s) OVER () = 0 THEN 1.0 ELSE max(s) OVER () END)), 4)::DOUBLE AS score FROM f""")


def tokenize_counts(spark, sf_dir):
    d = texts(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", T.tokens(F.coalesce("text", F.lit(""))).alias("t"))
    d = d.withColumn("m", F.transform(T.carrying(F.col("t")), T.inflection))
    return d.select("doc_id", F.size("t").alias("n_tokens"), F.size("m").alias("n_meaningful"), F.size(F.array_distinct("m")).alias("n_terms"), F.size(T.bigrams("m")).alias("n_bigrams"), F.md5(F.array_join("m", " ").cast("binary")).alias("digest"))


register("tokenize_counts", ("T1", "T2", "T3", "T4", "T5"), tokenize_counts, f"""
WITH d AS (SELECT doc_id, {D.tokens("coalesce(text, '')")} AS t, {D.meaningful("coalesce(text, '')")} AS m FROM documents)
SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(m) AS INTEGER) AS n_meaningful, CAST(len(list_distinct(m)) AS INTEGER) AS n_terms, CAST(len({D.bigrams('m')}) AS INTEGER) AS n_bigrams, md5(array_to_string(m, ' ')) AS digest FROM d""")

def identifier_tokens(spark, sf_dir):
    """URLs are full of identifiers: hosts, paths, versions, parameters."""
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(T.meaningful(F.coalesce("url", F.lit(""))), " ").alias("terms"))


register("identifier_tokens", ("T1", "T3"), identifier_tokens, f"SELECT page_id, array_to_string({D.meaningful("coalesce(url, '')")}, ' ') AS terms FROM pages")


def bigram_overlap(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.meaningful(F.coalesce("text", F.lit(""))).alias("w"))
    first = t.filter("turn = 0").select("conv_id", T.bigrams("w").alias("ask"), F.array_distinct("w").alias("terms"))
    j = t.filter("turn > 0").join(first, "conv_id")
    both = T.bigrams("w")
    return j.select("conv_id", "turn", F.size(F.array_intersect("ask", both)).alias("shared"), F.round(F.size(F.array_intersect("ask", both)) / F.greatest(F.size("ask"), F.lit(1)), 4).alias("overlap"), F.round(T.coverage(F.col("terms"), F.col("w")), 4).alias("coverage"), F.round(T.jaccard(F.col("terms"), F.array_distinct("w")), 4).alias("jaccard"))


register("bigram_overlap", ("T5", "R10", "W14"), bigram_overlap, f"""
WITH t AS (SELECT conv_id, turn, {D.meaningful("coalesce(text, '')")} AS w FROM conversations),
f AS (SELECT conv_id, {D.bigrams('w')} AS ask, list_distinct(w) AS terms FROM t WHERE turn = 0),
j AS (SELECT t.conv_id, turn, ask, terms, w, {D.bigrams('w')} AS b FROM t JOIN f USING (conv_id) WHERE turn > 0)
SELECT conv_id, turn, CAST(len(list_intersect(ask, b)) AS INTEGER) AS shared, round(len(list_intersect(ask, b)) / greatest(len(ask), 1)::DOUBLE, 4) AS overlap,
  round({D.coverage('terms', 'w')}, 4) AS coverage, round(len(list_intersect(terms, list_distinct(w))) / greatest(len(list_distinct(list_concat(terms, w))), 1)::DOUBLE, 4) AS jaccard FROM j""")


def proximity_min_gap(spark, sf_dir):
    terms = list(dict.fromkeys(T.meaningful_py(QUESTIONS["q5"])))
    d = texts(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", T.meaningful(F.coalesce("text", F.lit(""))).alias("w"))
    return d.select("doc_id", R.min_gap("w", terms).alias("gap"))


register("proximity_min_gap", ("R3",), proximity_min_gap, f"""
WITH q AS (SELECT unnest(list_distinct({D.meaningful("'" + QUESTIONS['q5'] + "'")})) AS term),
d AS (SELECT doc_id, {D.meaningful("coalesce(text, '')")} AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS pos FROM d),
m AS (SELECT doc_id, term, pos, lag(term) OVER (PARTITION BY doc_id ORDER BY pos) AS before, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS was FROM t SEMI JOIN q USING (term)),
g AS (SELECT doc_id, min(CASE WHEN term <> before THEN pos - was END) AS gap FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(gap AS INTEGER) AS gap FROM d LEFT JOIN g USING (doc_id)""")
