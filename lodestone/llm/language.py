"""Language identification as a mixture: which languages a document is made of, and in what proportions.

Each language has likelihoods of character trigrams. Expectation-maximisation estimates a document's proportions over a
set of languages; the set grows by one language at a time, as long as the likelihood gains more than its penalty.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, table

GRAMS = 1 << 16
UNKNOWN = "und"
#: Labelled documents that training reads for each language, about: documents are drawn by the hash of their ids.
TRAIN_DOCS = 2_000
#: Added to each trigram's count, and what a further language must gain: overlapping trigrams count each letter thrice.
SMOOTHING, PENALTY, ROUNDS = 0.05, 3.0, 25
#: Least share of a document that the learned languages explain for it to pass filter_languages(). Held-out documents have 0.67 or more, noise and foreign scripts 0.1 at most.
LEAST_EXPLAINED = 0.5

_MULTIPLY = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
#: Characters that stand in words (letters and marks), and letters, below U+3000.
_INSIDE, _LETTER = (np.array([unicodedata.category(chr(c))[0] in kinds for c in range(0x3000)]) for kinds in ("LM", "L"))


def trigrams(text: str | None) -> np.ndarray:
    """Hashed trigrams of the lower-cased letters and marks, with a blank wherever other characters stand; those centred on one. A text without a letter has none."""
    a = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter, inside = _LETTER[low := np.minimum(a, 0x2FFF)], _INSIDE[low]
    if len(high := np.nonzero(a >= 0x3000)[0]):
        kind = [unicodedata.category(chr(c))[0] for c in a[high].tolist()]
        letter[high], inside[high] = [k == "L" for k in kind], [k in "LM" for k in kind]
    if not letter.any():
        return np.zeros(0, np.uint32)
    a = np.concatenate(([0], np.where(inside, a, 0), [0])).astype(np.uint32)
    h = a[:-2] * _MULTIPLY[0] ^ a[1:-1] * _MULTIPLY[1] ^ a[2:] * _MULTIPLY[2]
    return ((h * np.uint32(0x27D4EB2F)) >> np.uint32(16))[inside]


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    g = trigrams(text)
    if len(g) > 20_000:
        n = np.bincount(g, minlength=GRAMS)
        return (u := np.nonzero(n)[0]), n[u]
    return np.unique(g, return_counts=True)


def proportions(p: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """EM for the weights of the columns of p (trigrams x languages) under counts n, and the log-likelihood."""
    w, total = np.full(p.shape[1], 1 / p.shape[1]), n.sum()
    for _ in range(rounds):
        new = w * ((n / (p @ w)) @ p) / total
        if np.abs(new - w).max() < 1e-4:
            w = new
            break
        w = new
    return w, float(n @ np.log(p @ w))


def infer(p: np.ndarray, n: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Proportions of all languages, 0 outside the chosen set; ties go to the earlier language."""
    single = n @ np.log(p)
    chosen, best = [int(single.argmax())], float(single.max())
    w, price = np.ones(1), penalty * np.log(max(n.sum(), 2))
    while len(chosen) < p.shape[1]:
        tries = []
        mix = p[:, chosen] @ w
        for k in range(p.shape[1]):
            if k not in chosen and (n / mix) @ p[:, k] > n.sum():  # else more of k cannot raise the likelihood
                tries.append((k, *proportions(p[:, [*chosen, k]], n)))
        if not tries:
            break
        k, new, score = max(tries, key=lambda x: x[2])
        if score - best <= price:
            break
        chosen, w, best = [*chosen, k], new, score
    out = np.zeros(p.shape[1])
    out[chosen] = w
    return out


class Model:
    """Languages in order of their names, and the likelihood of each hashed trigram in each of them."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        c = np.stack([counts[x] for x in self.languages], axis=1) if counts else np.zeros((GRAMS, 0))
        self.p = ((c + SMOOTHING) / (c.sum(axis=0) + SMOOTHING * GRAMS)).astype(np.float32)

    def predict(self, text: str | None) -> tuple[str, float, list[tuple[str, float]], float]:
        """Main language and its proportion, all proportions, and what share of the text these languages explain."""
        u, n = counted(text)
        if not len(u) or not self.languages:
            return UNKNOWN, 0.0, [], 0.0
        p, n = self.p[u].astype(np.float64), n.astype(np.float64)
        w = infer(p, n)
        k = int(w.argmax())
        # Against a text of no language, in which all trigrams are alike: what EM leaves to that is not explained.
        other, _ = proportions(np.column_stack([p @ w, np.full(len(u), 1 / GRAMS)]), n)
        return self.languages[k], float(min(max(w[k], 0.0), 1.0)), [(self.languages[i], float(w[i])) for i in np.argsort(-w, kind="stable") if w[i] > 0], float(min(max(other[0], 0.0), 1.0))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def fit(docs: DataFrame, most: int = TRAIN_DOCS) -> Model:
    """Train on whole texts of documents outside the held-out fold (remainder 1) that have a lang: about `most` a language."""
    rows = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 1))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model({})
    draw = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 20))
    rate = F.element_at(F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(1 << 20, -(-most * (1 << 20) // n))))), F.col("lang"))

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                u, n = counted(t)
                sums.setdefault(lang, np.zeros(GRAMS, np.int64))[u] += n
        for lang, c in sums.items():
            u = np.nonzero(c)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u), pa.string()), pa.array(u, pa.int32()), pa.array(c[u])], ["lang", "gram", "n"])

    # At most languages x GRAMS rows come to the driver.
    got = map_batches(rows.filter(draw < rate).select("lang", "text"), run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    counts = {lang: np.zeros(GRAMS) for lang in sizes}
    for lang, part in got.groupby("lang"):
        counts[lang][part["gram"].to_numpy()] = part["n"].to_numpy()
    return Model({k: c for k, c in counts.items() if c.any()})


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score (the main language's proportion), mixture (language, proportion), largest first, and explained.

    explained is the share of the text that the mixture accounts for better than a text of no language does; foreign
    scripts and noise have little of it. Only the text counts. A null text or one without letters, or a model without languages, gives `und`, 0, no mixture and 0.
    Columns of docs that have these four names, in any case, are replaced; the others stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    mixture = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
    names = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "mixture", "explained")]

    def run(batches):
        m = shared.value
        for b in batches:
            got = [m.predict(t) for t in b.column(names.index("text")).to_pylist()]
            cols = [pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), pa.array([[{"lang": a, "share": s} for a, s in x[2]] for x in got], mixture), pa.array([x[3] for x in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*names, "lang_pred", "score", "mixture", "explained"])

    rows = docs.select(*names)
    schema = ", ".join(f"`{c.replace('`', '``')}` {t}" for c, t in rows.dtypes)
    return map_batches(rows, run, f"{schema}, lang_pred string, score double, mixture array<struct<lang: string, share: double>>, explained double")


def filter_languages(docs: DataFrame, least: float = LEAST_EXPLAINED) -> DataFrame:
    """Documents of which the learned languages together explain at least `least`; others, and those without letters, go. Columns stay as they were, whatever their names.

    Without any labelled document to learn from, all documents with letters stay.
    """
    rest = [c for c in docs.columns if c != "text"]
    boxed = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in rest)).alias("rest"))
    model = fit(docs)
    if model.languages:
        kept = identify(boxed, model).filter((F.col("lang_pred") != UNKNOWN) & (F.col("explained") >= least))
    else:
        kept = boxed.filter(F.col("text").rlike(r"\p{L}"))
    return kept.select(*(F.col("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in docs.columns))


def op6_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score", "mixture")
