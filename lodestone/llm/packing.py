"""Cost-balanced packing of documents into training sequences.

Attention inside a piece costs its length plus a quadratic share. Documents go, longest first, to the cheapest sequence
that has room for them. Every task packs what it reads, shard by shard, so token ids are never shuffled.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import WordBpe
from .common import map_batches, table

LENGTH, END = 4096, 2
#: Tokens packed at once; a shard's ids are all that a task holds.
SHARD = 2_000_000
#: Chunks of text whose ids a worker remembers. Only speed depends on it.
REMEMBERED = 300_000
#: Bytes of a piece that `WordBpe` spells, whose steps grow with the square of it; the library spells longer ones, with a heap.
#: Longer chunks are not remembered, so that memory is bounded in bytes as well.
LONG = 64
#: Letters that normalisation only lower-cases (one piece) and the signs that may follow them (another); no apostrophes.
PIECES = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """The ids that the tokenizer gives for whole texts, with a memory for chunks between blanks.

    The tokenizer normalises character by character and never joins what white space parts, so a text's ids are
    those of its chunks, one after another, however long; tests compare this with plain encoding.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.tokenizer, self.words, self.known, self.remembered = Tokenizer.from_file(path), WordBpe(path), {"": b""}, remembered

    def _plain(self, chunks: list[str]) -> list[bytes]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [np.array(e.ids, "<u4").tobytes() for e in encode(chunks, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Remembers the ids of new chunks; returns those of the long ones."""
        known, pieces, other, long = self.known, [], [], []
        for c in new:
            m = PIECES.fullmatch(c) if len(c) <= LONG else None
            if m and len(m[1].encode()) <= LONG:
                pieces.append((c, m[1].lower(), m[2]))
            else:
                (other if len(c) <= LONG else long).append(c)
        ask = list({x for _, w, mark in pieces for x in (w, mark)} - known.keys())
        known.update(zip(ask, self.words.encode([w.encode() for w in ask]), strict=True))
        for c, w, mark in pieces:
            known[c] = known[w] + known[mark]
        for at in range(0, len(other), 4096):
            known.update(zip(other[at : at + 4096], self._plain(other[at : at + 4096]), strict=True))
        return {c: self._plain([c])[0] for c in long}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, and where each text's ids begin; the last entry is their end."""
        chunks = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = pc.dictionary_encode(chunks.flatten())
        own = coded.dictionary.to_pylist()
        if len(self.known) > self.remembered:
            self.known = {"": b""}
        new = [c for c in own if c not in self.known]
        long = self._learn(new) if new else {}
        self.known.update(long)
        values = [self.known[c] for c in own]
        for c in long:
            del self.known[c]
        flat, size = np.frombuffer(b"".join(values), "<u4"), np.fromiter(map(len, values), np.int64, len(values)) // 4
        code = coded.indices.to_numpy(zero_copy_only=False)
        took = size[code]
        ends = np.cumsum(took)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat((np.cumsum(size) - size)[code] - (ends - took), took) + np.arange(total)]
        at = chunks.offsets.to_numpy() - chunks.offsets[0].as_py()
        return ids, np.append(0, ends)[at]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def assign(lengths: list[int], length: int = LENGTH, linear: float = 1.0, quadratic: float = 1.0 / LENGTH, over: list[tuple[int, int, int]] | None = None) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that cover all documents without any padding.

    What a document has beyond whole sequences competes, longest first, for the cheapest sequence with room (the earlier one among equals). What fits
    nowhere whole is cut to fill the rooms left, cheapest first. Fewer than `length` tokens are over then: a list `over` gets them
    as (document, start, length), for the next call; without one they form sequences of powers of two.
    """
    out, rests, sequences = [], [], 0
    for d, n in enumerate(lengths):
        for start in range(0, n - n % length, length):
            out.append((d, start, length, sequences, 0))
            sequences += 1
        if n % length:
            rests.append((d, n - n % length, n % length))
    bins = sum(r[2] for r in rests) // length
    cost, room, waiting = np.zeros(bins), np.full(bins, length), []
    for d, start, n in sorted(rests, key=lambda r: (-r[2], r[0])):
        open_to = np.where(room >= n, cost, np.inf)
        k = int(open_to.argmin()) if bins else -1
        if k < 0 or open_to[k] == np.inf:
            waiting.append((d, start, n))
            continue
        out.append((d, start, n, sequences + k, length - int(room[k])))
        room[k] -= n
        cost[k] += linear * n + quadratic * n * n
    spaces = [(sequences + int(k), length - int(room[k]), int(room[k])) for k in np.argsort(cost, kind="stable") if room[k]]
    more, nxt = sum(w[2] for w in waiting) - sum(s[2] for s in spaces), sequences + bins
    for bit in reversed(range(more.bit_length() if over is None else 0)):
        if more >> bit & 1:
            spaces.append((nxt, 0, 1 << bit))
            nxt += 1
    waiting.reverse()
    for k, at, n in spaces:
        while n:
            d, start, m = waiting.pop()
            took = min(m, n)
            out.append((d, start, took, k, at))
            at, n = at + took, n - took
            if took < m:
                waiting.append((d, start + took, m - took))
    if over is not None:
        over += reversed(waiting)
    return out


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, length: int = LENGTH, end: int = END, shard: int = SHARD, with_ids: bool = False) -> DataFrame:
    """One row per piece: see SCHEMA, and with `with_ids` the piece's ids (little-endian unsigned 32-bit, binary).

    Each row of docs is one document (repeated rows are packed as often as they come): its ids and the id `end`. A null text counts as empty and gives that id alone;
    doc_id may be null. Every id lies in exactly one piece and sequences have no padding: they hold `length` tokens, but for the
    last ones of each task, which hold powers of two; what is over in a shard goes to the task's next one. sequence_id is unique over the table: the task's number, then the sequence's within the task.
    Other columns are ignored.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")

    def run(batches):
        enc, base, made, size = encoder(path), TaskContext.get().partitionId() << 40, 0, 0

        def packed(names, rows, at, whole, last):
            """The pieces of rows (ids from at on, of whole in all), and what is over for the next shard."""
            nonlocal made
            over = None if last else []
            pieces = assign([len(x) for x in rows], length, over=over)
            rest = [([x[i] for i, _, _ in over or ()]) for x in (names, rows, at, whole)]
            rest[1] = [r[s : s + n].copy() for r, (_, s, n) in zip(rest[1], over or (), strict=True)]
            rest[2] = [a + s for a, (_, s, _) in zip(rest[2], over or (), strict=True)]
            if not pieces:
                return None, rest
            crc = [zlib.crc32(rows[d][s : s + n]) for d, s, n, _, _ in pieces]
            d, s, n, q, o = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
            cols = [pa.array([names[i] for i in d], pa.int64()), np.array(at, np.int64)[d] + s, n, np.array(crc, np.int64), np.array(whole, np.int64)[d], base + made + q, o]
            if with_ids:
                cols.append(pa.array([rows[i][a : a + m].tobytes() for i, a, m in zip(d, s, n, strict=True)], pa.binary()))
            made += int(q.max()) + 1
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], [f.split()[0] for f in schema.split(", ")]), rest

        held: list[list] = [[], [], [], []]
        for b in batches:
            flat, ends = enc.encode(b.column(1))
            for name, s, e in zip(b.column(0).to_pylist(), ends.tolist(), ends[1:].tolist(), strict=False):
                row = np.append(flat[s:e], np.uint32(end))
                for x, v in zip(held, (name, row, 0, len(row)), strict=True):
                    x.append(v)
                size += len(row)
                if size >= shard:
                    out, held = packed(*held, False)
                    size = sum(map(len, held[1]))
                    if out:
                        yield out
        if held[1]:
            yield packed(*held, True)[0]

    schema = SCHEMA + ", ids binary" * with_ids
    return map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), run, schema)


def op3_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
