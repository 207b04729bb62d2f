from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestone.llm import packing as K

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_ids_are_the_tokenizers(spark, sf_dir, tokenizer):
    import pyarrow as pa

    rng = random.Random(6)
    odd = ["it's  don't\tI'LL <|endoftext|>x", "Straße ÀÉ é é ́x 中文 12.5% a1b2", "'sabc x'store \x1c \x85 İI ΣΑΣ", "\n\n", "", "...", "a.b,c!!d #tag|pipe", "ǅ ﬁ ½²", "µ ª º ÷ × þ"]
    odd += ["".join(rng.choices("abzAZ09éßÿ .,!'|\n\t中́", k=rng.randint(1, 30))) for _ in range(2000)]
    texts = odd + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for remembered in (10, 10**6):
        ids, at = K.Encoder(PATH, remembered).encode(pa.array(texts))
        for k, t in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t
    assert K.Encoder(PATH).encode(pa.array([], pa.string()))[0].tolist() == []


def test_long_words(tokenizer):
    import time

    import pyarrow as pa

    rng = random.Random(8)
    texts = ["".join(rng.choices("abcdefghiéß", k=n)) + tail for n in (63, 64, 65, 5_000, 1_000_000) for tail in ("", "!!", "!" * 70, " and more", "中")]
    texts += ["!" * 300_000, "x" * 300_000, "中文" * 50_000]
    began, enc = time.perf_counter(), K.Encoder(PATH)
    ids, at = enc.encode(pa.array(texts))
    assert time.perf_counter() - began < 60 and max(map(len, enc.known)) <= K.LONG
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def brute_assign(rests, length):
    """Each rest, longest first, in the cheapest of the sequences with room, by loops: {document: sequence} of those that fit whole."""
    bins, out = [[0.0, length] for _ in range(sum(n for _, n in rests) // length)], {}
    for d, n in sorted(rests, key=lambda r: (-r[1], r[0])):
        fits = [k for k, b in enumerate(bins) if b[1] >= n]
        if fits:
            k = min(fits, key=lambda k: (bins[k][0], k))
            bins[k] = [bins[k][0] + n + n * n / length, bins[k][1] - n]
            out[d] = k
    return out


def test_rests_go_to_the_cheapest_sequence():
    rng = random.Random(12)
    for _ in range(40):
        lengths = [rng.randint(1, 6_000) for _ in range(rng.randint(1, 60))]
        full = sum(n // K.LENGTH for n in lengths)
        want = brute_assign([(d, n % K.LENGTH) for d, n in enumerate(lengths) if n % K.LENGTH], K.LENGTH)
        got = {d: q - full for d, s, n, q, _ in K.assign(lengths) if n == lengths[d] % K.LENGTH and s == lengths[d] - n and d in want}
        assert got == want


def test_what_is_over_goes_to_the_next_shard(spark, documents):
    rng = random.Random(13)
    rows = [(i, " ".join(rng.choices(["a", "the", "word", "zq"], k=rng.randint(1, 3_000)))) for i in range(60)]
    docs = documents(rows).coalesce(1)
    extra = docs.selectExpr("*", "1 AS start", "2 AS length", "3 AS IDS", "4 AS sequence_id", "5 AS offset")
    for shard in (5_000, 2_000_000):
        got = K.pack(extra, shard=shard, with_ids=True).collect()
        seqs, parts = defaultdict(int), defaultdict(list)
        for r in got:
            seqs[r.sequence_id] += r.length
            parts[r.doc_id].append((r.start, bytes(r.ids), r.doc_tokens))
        short = [n for n in seqs.values() if n != K.LENGTH]
        assert sum(short) < K.LENGTH and len(short) <= 12  # one task ends once
        for i, t in rows:
            whole = b"".join(x[1] for x in sorted(parts[i]))
            assert whole == np.array([*Tokenizer.from_file(PATH).encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes() if i < 5 else len(whole) == 4 * parts[i][0][2]


def covered(lengths, pieces, length=K.LENGTH):
    parts, seqs = defaultdict(list), defaultdict(list)
    for d, s, n, q, o in pieces:
        assert n > 0
        parts[d].append((s, n))
        seqs[q].append((o, n))
    for d, n in enumerate(lengths):
        end = 0
        for s, m in sorted(parts[d]):
            assert s == end
            end += m
        assert end == n
    for rows in seqs.values():
        end = 0
        for o, m in sorted(rows):
            assert o == end
            end += m
        assert end == length or end & (end - 1) == 0
    return seqs


def test_assignment():
    rng = random.Random(7)
    for _ in range(60):
        lengths = [int(rng.paretovariate(0.7)) + 1 for _ in range(rng.randint(0, 80))]
        covered(lengths, K.assign(lengths))
    covered([4096, 4096, 1, 8192], K.assign([4096, 4096, 1, 8192]))
    assert K.assign([]) == []


def test_costs_are_balanced():
    lengths = [1024] * 40 + [512] * 80 + [64] * 640
    cost = defaultdict(float)
    for _, _, n, q, _ in K.assign(lengths):
        cost[q] += n + n * n / K.LENGTH
    whole = sorted(cost.values())
    assert whole[-1] / whole[0] < 1.2


def test_pieces_of_rows(spark, documents, awkward, tokenizer):
    df = K.pack(documents(awkward), with_ids=True, shard=4000)
    rows = df.collect()
    ids = defaultdict(dict)
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        ids[r.doc_id].setdefault(r.start, set()).add(bytes(r.ids))
    whole = np.frombuffer(b"".join(next(iter(ids[6][s])) for s in sorted(ids[6])), "<u4").tolist()
    assert whole == [*tokenizer.encode(awkward[8][1], add_special_tokens=False).ids, 2]
    assert all(r.doc_tokens == 1 for r in rows if r.doc_id in (1, 2, 3))
    assert sum(r.length for r in rows if r.doc_id is None) == 1 + len(tokenizer.encode("a text without an id", add_special_tokens=False).ids) + 1
    assert K.pack(documents(awkward).limit(0)).count() == 0


def test_whole_table(spark, sf_dir, tokenizer):
    rows = K.op3_packing(spark, sf_dir).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    assert all((n := sum(m for _, m in s)) == 4096 or n & (n - 1) == 0 for s in seqs.values())
    for r in rows[:200]:
        want = [*tokenizer.encode(docs[r.doc_id], add_special_tokens=False).ids, 2]
        assert r.doc_tokens == len(want) and r.ids_crc32 == zlib.crc32(np.array(want[r.start : r.start + r.length], "<u4").tobytes())
