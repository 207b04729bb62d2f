"""Quality rules: counts over whole texts, and a linear-chain conditional random field that labels lines.

Only documents have labels, so the field learns its lines' labels by multiple instances: all lines of a good document are content,
and a bad document has at least one line of boilerplate. Which of its lines these are is settled by training and decoding in turn, first
by each line's own evidence, then with the moves between neighbouring lines of one document. Viterbi decoding marks each line of a
document as content or boilerplate, and the share of words in content lines decides whether the document stays.
"""

from __future__ import annotations

import operator
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, table

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
CAPITALS, DIGITS, MARKS = bytes(range(65, 91)), b"0123456789", b"!?"
LEAST_WORDS, MOST_REPEATED = 50, 50
CONTENT_SHARE = 0.5
#: Most labelled documents that training reads, and consecutive lines of each: the sample is bounded in bytes too.
TRAIN_DOCS, TRAIN_LINES = 2_000, 64
#: Rounds of labelling by lines alone, and in sequences.
ALONE, TOGETHER = 3, 2
FEATURES = 11


def line_features(words: list[bytes], line: bytes, repeated: bool) -> tuple[float, ...]:
    """The last feature, whether the line is the first or last of its text, is set by measure()."""
    n = max(len(line), 1)
    share = lambda chars: (len(line) - len(line.translate(None, chars))) / n
    return (
        1.0, min(10 * share(SYMBOLS), 2.0), min(4 * share(CAPITALS), 2.0), min(10 * share(DIGITS), 2.0), min(10 * share(MARKS), 2.0),
        1 - len(set(words)) / len(words), float(len(words) < 4), float(repeated), min(np.log1p(len(words)) / 5, 2.0),
        sum(map(operator.eq, words, words[1:])) / len(words), 0.0,
    )


def measure(text: str | None) -> tuple[tuple[int, int, int, int, int], np.ndarray, np.ndarray]:
    """(words, their code points, symbols, repeated lines, words in repeated three-word windows), line features and words per line."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    seen: set[bytes] = set()
    repeats, rows, sizes, words = 0, [], [], []
    for line in raw.split(b"\n"):
        own = line.split()
        if own:
            again = line in seen
            repeats += again
            seen.add(line)
            rows.append(line_features(own, line, again))
            sizes.append(len(own))
            words += own
    windows = list(zip(words, words[1:], words[2:], strict=False))
    covered = 0
    if len(set(windows)) < len(windows):
        often, upto = Counter(windows), 0
        for i, w in enumerate(windows):
            if often[w] > 1:
                covered += i + 3 - max(i, upto)
                upto = i + 3
    blanks = len(raw) - len(raw.translate(None, SPACES))
    counts = len(words), len(text or "") - blanks, len(raw) - len(raw.translate(None, SYMBOLS)), repeats, covered
    features = np.array(rows, np.float64).reshape(-1, FEATURES)
    features[[0, -1] if rows else [], -1] = 1.0
    return counts, features, np.array(sizes, np.int64)


# ---- the field: label 0 is boilerplate, 1 is content ----


def viterbi(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best labels of a sequence. scores: lines x 2, moves[a, b]: from a to b; ties go to the smaller label."""
    s, back = scores[0], np.zeros(scores.shape, np.int8)
    (m00, m01), (m10, m11) = moves.tolist()
    a, b = s.tolist()
    for t in range(1, len(scores)):
        x, y = scores[t].tolist()
        back[t, 0], back[t, 1] = b + m10 > a + m00, b + m11 > a + m01
        a, b = max(a + m00, b + m10) + x, max(a + m01, b + m11) + y
    out = np.zeros(len(scores), np.int8)
    out[-1] = b > a
    for t in range(len(scores) - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def train(sequences: list[tuple[np.ndarray, np.ndarray]], rounds: int = 150, rate: float = 0.5, decay: float = 1e-3, start: tuple[np.ndarray, np.ndarray] | None = None, chained: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x 2) and moves (2 x 2) by gradient ascent on the log-likelihood, forward and backward.

    chained: whether neighbouring lines matter; without, moves stay 0. Without sequences, PRIOR speaks.
    """
    weights, moves = (x.copy() for x in start) if start else (np.zeros((FEATURES, 2)), np.zeros((2, 2)))
    if not sequences:
        return PRIOR, np.array([[0.5, -0.5], [-0.5, 0.5]])
    n, most = len(sequences), max(len(y) for _, y in sequences)
    x, y, there = np.zeros((n, most, FEATURES)), np.zeros((n, most), np.int64), np.zeros((n, most), bool)
    for k, (f, label) in enumerate(sequences):
        x[k, : len(label)], y[k, : len(label)], there[k, : len(label)] = f, label, True
    total, hot = there.sum(), np.eye(2)[y] * there[..., None]
    pairs = there[:, 1:] & there[:, :-1]
    seen = np.einsum("nta,ntb->ab", hot[:, :-1] * pairs[..., None], hot[:, 1:])
    mw, mm = np.zeros_like(weights), np.zeros_like(moves)
    for _ in range(rounds):
        s = x @ weights
        if not chained:
            p = np.exp(s - np.logaddexp(s[..., :1], s[..., 1:])) * there[..., None]
            mw = 0.9 * mw + (np.einsum("ntf,nta->fa", x, hot - p) / total - decay * weights)
            weights = weights + rate * mw
            continue
        fwd, bwd = s.copy(), np.zeros_like(s)
        for t in range(1, most):
            fwd[:, t] = np.where(there[:, t, None], np.logaddexp(fwd[:, t - 1, :1] + moves[0], fwd[:, t - 1, 1:] + moves[1]) + s[:, t], fwd[:, t - 1])
        for t in range(most - 2, -1, -1):
            ahead = bwd[:, t + 1] + s[:, t + 1]
            bwd[:, t] = np.where(there[:, t + 1, None], np.logaddexp(ahead[:, :1] + moves[:, 0], ahead[:, 1:] + moves[:, 1]), 0.0)
        z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        p = np.exp(fwd + bwd - z[:, None, None]) * there[..., None]
        ahead = (bwd + s)[:, 1:]
        both = np.exp(fwd[:, :-1, :, None] + moves + ahead[:, :, None, :] - z[:, None, None, None]) * pairs[..., None, None]
        mw = 0.9 * mw + (np.einsum("ntf,nta->fa", x, hot - p) / total - decay * weights)
        mm = 0.9 * mm + ((seen - both.sum((0, 1))) / total - decay * moves)
        weights, moves = weights + rate * mw, moves + rate * mm
    return weights, moves


#: Used where no document has a label: signs, capitals and repeats speak for boilerplate.
PRIOR = np.stack([np.array([-1.5, 2.0, 1.0, 0.5, 2.0, 4.0, 0.3, 1.0, -0.5, 4.0, 0.0]), np.zeros(FEATURES)], axis=1)


def relabel(bags: list[tuple[np.ndarray, bool]], weights: np.ndarray, moves: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Lines and their labels: all content in a good document; in a bad one as decoded, its least content-like line always boilerplate."""
    out = []
    for f, good in bags:
        y = np.ones(len(f), np.int64)
        if not good:
            s = f @ weights
            y = viterbi(s, moves).astype(np.int64)
            y[int((s[:, 1] - s[:, 0]).argmin())] = 0
        out.append((f, y))
    return out


def learn(bags: list[tuple[np.ndarray, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """The field from documents' lines and labels. bags: features of consecutive lines of one document, whether it is good."""
    bags = [(f, good) for f, good in bags if len(f)]
    lines = [(f, np.full(len(f), int(good))) for f, good in bags]
    if not bags or len({good for _, good in bags}) < 2:
        return train([])
    found = train(lines, rounds=60, chained=False)
    for _ in range(ALONE):
        found = train(relabel(bags, *found), rounds=40, start=found, chained=False)
    for k in range(TOGETHER):
        found = train(relabel(bags, *found), rounds=40 if k < TOGETHER - 1 else 80, start=found)
    return found


def sample(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, lines: int = TRAIN_LINES) -> list[tuple[np.ndarray, bool]]:
    """(lines' features, good) of the `most` labelled documents whose ids hash lowest, `lines` consecutive lines of each: a bounded sample, the same on every run.

    The best of repeated labels holds. Of an id with several rows, one gives the lines.
    """
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(most)

    def run(batches):
        for b in batches:
            cut = []
            for order, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                f = measure(t)[1]
                at = order % max(1, len(f) - lines + 1)
                cut.append(f[at : at + lines].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cut, pa.binary())], ["order", "quality", "features"])

    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("order", F.col("quality").cast("int"), "text")
    got = map_batches(rows, run, "order long, quality int, features binary").groupBy("order", "quality").agg(F.min("features").alias("features")).collect()
    return [(np.frombuffer(r.features, "<f4").reshape(-1, FEATURES).astype(np.float64), r.quality > 0) for r in sorted(got, key=lambda r: r.order)]


def judge(docs: DataFrame, weights: np.ndarray, moves: np.ndarray, share: float = CONTENT_SHARE) -> DataFrame:
    """One row per row of docs: the counts, base_failed, content_share (of words; null without any) and kept.

    A null text has no words and fails. A document without a content line is not kept; repeated rows are judged alike. Only doc_id
    and text are read: other columns, whatever their names, are ignored.
    """
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            counts, failed, kept, shares = [], [], [], []
            for t in b.column(1).to_pylist():
                c, f, sizes = measure(t)
                counts.append(c)
                failed.append(c[0] < LEAST_WORDS or 100 * c[4] > MOST_REPEATED * c[0])
                shares.append(float(sizes[viterbi(f @ weights, moves) == 1].sum() / c[0]) if len(f) else None)
                kept.append(not failed[-1] and shares[-1] is not None and shares[-1] >= share)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in zip(*counts, strict=True)), pa.array(failed), pa.array(kept), pa.array(shares, pa.float64())], names)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_batches(rows, run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double")


def op10_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return judge(docs, *learn(sample(docs, table(spark, sf_dir, "labels"))))
