"""Secret scans: patterns for named secrets, and a token-efficiency test for random strings.

A subword vocabulary spells text in few long tokens and random strings in many short ones. Runs of
key-like characters with few characters per token are reported, after leaving out digests and identifiers.
"""

from __future__ import annotations

import base64
import re

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, table

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: A run that starts a match and is too short matches nothing later within itself, so the least length can be in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST = {"assign": 8, "access": 16, "hex": 32}

#: Runs that the method judges, and what it leaves out: digests of usual lengths, UUIDs, and names made of words and numbers.
RUN = re.compile(r"[A-Za-z0-9+/_=-][A-Za-z0-9+/_=.-]{18,}[A-Za-z0-9+/_=-]")
#: What a run that is not random as a whole may hold: a key as one step of a path, or one part of a dotted name.
STEP = re.compile(r"[A-Za-z0-9+_=-]{20,}")
DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
DIGEST_LENGTHS = (32, 40, 48, 56, 64, 96, 128)
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
#: Both patterns never give back what they have taken, so that they pass over a run once.
NAME = re.compile(r"(?:[A-Z]{2,}+(?:[a-z]{2,}+)?|[A-Z]?[a-z]{2,}+|[0-9]++|[/_=+-])++\Z")
VERSION = re.compile(r"v?[0-9]++(?:\.[0-9]++)++(?:[-+._][A-Za-z]*+[0-9]*+)*+\Z")
#: Characters per token under which a run counts as random: random base 62 has about 1.6, prose with digits 2.3 or more.
RATIO = 2.1
#: The same for runs without a digit, or with a dot: random letters have about 1.4, of one case 1.7; capitals, joined words and names of hosts 2.0 or more.
LETTERS_RATIO = 1.9
#: The same for runs that look like names: random base 32, of capitals and digits, has about 1.4 and seldom over 1.7.
NAME_RATIO = 1.75


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the pattern matches, leftmost and non-overlapping for each kind; code points, end exclusive."""
    out = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def identifier(run: str) -> bool:
    core = run.strip("=-_/+")
    if not any(c.isalpha() for c in core):
        return True  # a number
    return bool(UUID.match(core) or VERSION.match(core)) or (len(core) in DIGEST_LENGTHS and bool(DIGEST.match(core)))


def outside(start: int, end: int, taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The parts of a run that no span covers."""
    out = []
    for s, e, _ in sorted(x for x in taken if x[0] < end and start < x[1]):
        out.append((start, s))
        start = max(start, e)
    return [(s, e) for s, e in [*out, (start, end)] if e > s]


def is_random(run: str, encode, ratio: float = RATIO) -> bool:
    """Whether a run takes too many tokens for its length to be text. Runs that look like names, of words and numbers with separators, need a lower ratio."""
    if identifier(run):
        return False
    digits, words = any(c.isdigit() for c in run), re.findall(r"[A-Za-z]+", run)
    if not digits or "." in run:
        ratio = min(ratio, LETTERS_RATIO)
    if NAME.match(run) and (digits or not run.isalpha()) and max(map(len, words)) >= 6:
        ratio = min(ratio, NAME_RATIO)
    return len(run) / max(len(encode(run)), 1) < ratio


def random_spans(text: str, taken: list[tuple[int, int, str]], encode, ratio: float = RATIO) -> list[tuple[int, int, str]]:
    """The random runs of what no span covers; of a run that is not random as a whole, its random steps."""
    out = []
    for m in RUN.finditer(text):
        for start, end in outside(m.start(), m.end(), taken):
            run = RUN.search(text, start, end)
            if run and is_random(run[0], encode, ratio):
                out.append((run.start(), run.end(), "random"))
            elif run:
                out += [(x.start(), x.end(), "random") for x in STEP.finditer(text, start, end) if x[0] != run[0] and is_random(x[0], encode, ratio)]
    return out


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


_ENCODINGS: dict[str, tiktoken.Encoding] = {}


def encoding(path: str) -> tiktoken.Encoding:
    if path not in _ENCODINGS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, ratio: float = RATIO) -> DataFrame:
    """(doc_id, found array<struct<kind, start, end, text>>): the secrets of each row's whole text, by start, then kind.

    A null or empty text has none. Rows are judged one by one, so repeats and other columns, whatever their names, make no difference. A span of the method never overlaps one of the patterns.
    """
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())])

    def run(batches):
        encode = encoding(path).encode_ordinary
        for b in batches:
            found = []
            for t in b.column(1).to_pylist():
                spans = base_spans(t) if t else []
                spans += random_spans(t, spans, encode, ratio) if t else []
                found.append([{"kind": k, "start": s, "end": e, "text": t[s:e]} for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(item))], ["doc_id", "found"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, found array<struct<kind: string, start: long, end: long, text: string>>")


def op1_secret_scan(spark, sf_dir):
    found = scan(table(spark, sf_dir, "documents"))
    named = lambda base: F.array_join(F.transform(F.filter("found", lambda x: x["kind"] != "random") if base else F.col("found"), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(named(True), 256).alias("base_sha256"), named(False).alias("spans"), count("random").alias("n_random"),
    )
