"""Near-duplicate results at any group size: a similarity join over strings, then a merge in order of place.

Two strings are alike when difflib's ratio reaches a limit. That bounds what they have apart, so their lengths, their letters and their
short runs of signs are nearly the same. Only strings of which that is so are compared, once each way, since the ratio
depends on which comes first. Lengths and letters are compared for all pairs of a group's domain, 64 bytes a string. Links between results make small components, and the merge folds over one component at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.plans.batches import bounded, dealt, map_pieces
from lodestone.plans.lineage import cut

from .graph import components

#: Limits of the ratio (fixed values): titles, snippets.
TITLE_RATIO, SNIPPET_RATIO = 0.93, 0.94
LIMITS = (TITLE_RATIO, SNIPPET_RATIO)
GRAM = 3
#: Bins of letters, growth of sizes from band to band (above (2 - r) / r for both ratios r), strings of a block on average, bins of runs.
LETTERS, BAND, BLOCK, RUNS = 64, 1.17, 4_096, 4_093


def alike(a: str, b: str, least: float) -> bool:
    """SequenceMatcher's ratio reaches `least`; lengths and letters rule most pairs out before the comparison."""
    if 2 * min(len(a), len(b)) < least * (len(a) + len(b)):
        return False
    m = SequenceMatcher(None, a, b)
    return m.quick_ratio() >= least and m.ratio() >= least


def may_be_alike(a: str, b: str, least: float) -> bool:
    """Whether runs of GRAM signs, in RUNS bins, allow the ratio: each sign that is not matched, (1 - least) of both sizes at most, changes 2 GRAM - 1 runs."""

    def runs(text: str) -> np.ndarray:
        signs = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        n = max(len(signs) - GRAM + 1, 0)
        return np.bincount(sum((signs[k : k + n] * 31**k for k in range(GRAM)), np.zeros(n, np.int64)) % RUNS, minlength=RUNS)

    return int(np.abs(runs(a) - runs(b)).sum()) <= (2 * GRAM - 1) * ((1 - least) * (len(a) + len(b)) + 1e-6)


def folded_case(c: str) -> Column:
    """Python's case folding, which the ratio is taken after."""

    @F.pandas_udf(T.StringType())
    def fold(s: pd.Series) -> pd.Series:
        return s.str.casefold()

    return fold(c)


def _grams(strings: DataFrame) -> DataFrame:
    """(cell, id, kind, size, band, letters): how often each string has each letter, in LETTERS bins and up to 255; strings that are alike are of one band of sizes or of neighbouring ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, bands, letters = [], [], []
            for text in b.column(3).to_pylist():
                signs = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                sizes.append(len(signs))
                bands.append(int(np.log(max(len(signs), 1)) / np.log(BAND)))
                letters.append(np.minimum(np.bincount(signs % LETTERS, minlength=LETTERS), 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sizes, pa.int32()), pa.array(bands, pa.int32()), pa.array(letters, pa.binary())], ["cell", "id", "kind", "size", "band", "letters"])

    return map_pieces(strings.select("cell", "id", "kind", "text"), run, "cell long, id long, kind int, size int, band int, letters binary")


def candidates(size: np.ndarray, letters: np.ndarray, block: np.ndarray, home: np.ndarray, across: bool, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs that sizes and letters leave: between the two blocks, if across, else in the one, and not of two guests.

    What the ratio leaves unmatched, (1 - least) of both sizes at most, is no less than what two strings' letters differ by, and bins and the bound of 255 make that only less.
    """
    for at in range(0, len(size), 64):
        end = min(at + 64, len(size))
        mine, other = letters[at:end, None], letters[None, at:]
        total = size[at:end, None] + size[None, at:]
        fits = (2 * np.minimum(size[at:end, None], size[None, at:]) >= least * total - 1e-6) & (home[at:end, None] | home[None, at:])
        fits &= np.arange(at, end)[:, None] < np.arange(at, len(size))[None]
        if across:
            fits &= block[at:end, None] != block[None, at:]
        if fits.any():
            fits &= (np.maximum(mine, other) - np.minimum(mine, other)).sum(axis=2, dtype=np.int32) <= (1 - least) * total + 1e-6
            i, j = np.nonzero(fits)
            yield at + i, at + j


def alike_strings(strings: DataFrame) -> DataFrame:
    """(cell, later, earlier): ids of strings (cell, id, kind, text) of one cell whose ratio, the later one's text first, reaches the limit of their kind.

    strings hold each text of a cell once. Equal texts need no row. A cell's strings of neighbouring bands meet as rows of a few bytes, in pairs of blocks of
    about BLOCK, so that no task gets more than two blocks of a cell at a time.
    """
    own = cut(_grams(strings))
    row = ["cell", "id", "kind", "size", "letters"]
    both = own.select(*row, "band", F.lit(True).alias("home")).unionByName(own.select(*row, (F.col("band") - 1).alias("band"), F.lit(False).alias("home")))
    of = both.groupBy("cell", "band").agg(F.count(F.lit(1)).alias("m"), F.max("home").alias("any")).filter("m > 1 and any").drop("any")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    met = both.join(of, ["cell", "band"]).withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least("block", k).alias("x"), F.greatest("block", k).alias("y")))
    met = dealt(met.withColumn("pair", F.explode(pair)).select(*row, "band", "home", "block", "pair"), "cell", "band", "pair")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cell, kind, across, members in zip(*(b.column(k).to_pylist() for k in range(3)), b.column(3), strict=True):
                v = members.values
                name, size, block, home = (v.field(c).to_numpy(zero_copy_only=False) for c in ("id", "size", "block", "home"))
                letters = np.frombuffer(b"".join(v.field("letters").to_pylist()), np.uint8).reshape(len(v), LETTERS)
                for i, j in candidates(size, letters, block, home, across, LIMITS[kind]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), cell), pa.int64()), pa.array(name[i], pa.int64()), pa.array(name[j], pa.int64())], ["cell", "x", "y"])

    members = met.groupBy("cell", "kind", "band", "pair").agg(F.collect_list(F.struct("id", "size", "block", "home", "letters")).alias("members"))
    pairs = map_pieces(members.select("cell", "kind", (F.col("pair.x") < F.col("pair.y")).alias("across"), "members"), meet, "cell long, x long, y long")
    text = lambda name: strings.select("cell", F.col("id").alias(name), "kind", F.col("text").alias(f"{name}_text"))
    pairs = cut(pairs).join(text("x"), ["cell", "x"]).join(text("y").drop("kind"), ["cell", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], []]
            for cell, x, y, kind, p, q in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not may_be_alike(p, q, LIMITS[kind]):
                    continue
                for later, earlier, s, t in ((x, y, p, q), (y, x, q, p)):
                    if alike(s, t, LIMITS[kind]):
                        for o, v in zip(out, (cell, later, earlier), strict=True):
                            o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["cell", "later", "earlier"])

    return map_pieces(dealt(pairs.select("cell", "x", "y", "kind", "x_text", "y_text")), run, "cell long, later long, earlier long")


class Kept:
    """The results of one component that stand so far, found by URL, by title and by the snippet that they show now."""

    def __init__(self) -> None:
        self.pos: list[int] = []
        self.domain: list[str] = []
        self.shown: list[tuple[int, int]] = []  # length and id of the snippet
        self.by: dict[tuple, set[int]] = {}

    def put(self, r: dict) -> int:
        """The place of the result that r joins: the first that it repeats, else its own."""
        keys = [("u", r["canonical_url"]), *(("t", r["domain"], t) for t in [r["tid"], *(r["tn"] or ())])]
        if r["length"]:
            keys += [("s", r["domain"], s) for s in [r["sid"], *(r["sn"] or ())]]
        found = [k for key in keys for k in self.by.get(key, ())]
        if not found:
            k = len(self.pos)
            self.pos.append(r["pos"])
            self.domain.append(r["domain"])
            self.shown.append((0, 0))
            self.by.setdefault(("u", r["canonical_url"]), set()).add(k)
            self.by.setdefault(("t", r["domain"], r["tid"]), set()).add(k)
        else:
            k = min(found)
        size, name = self.shown[k]
        if r["length"] > size:
            if size:
                self.by[("s", self.domain[k], name)].discard(k)
            self.shown[k] = (r["length"], r["sid"])
            self.by.setdefault(("s", self.domain[k], r["sid"]), set()).add(k)
        return self.pos[k]


def near_results(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Results merged with the first kept one of the same URL, whatever its domain, or of the same domain with nearly the same title or snippet.

    rows: by, pos (one row each within a group), canonical_url, domain, title, snippet, engines, search_score, normalised and
    non-null. The kept row gathers engines, the best score and the longest snippet, the earlier of equal ones; later rows are compared with the snippet that it shows by then. Groups
    can have any size: no task sees more than one component of links, a row at a time, and what it remembers of those kept.
    """
    bounded(rows)
    names = rows.columns
    g = F.xxhash64(*by) if by else F.lit(0).cast("long")
    keyed = cut(rows.withColumns({"g": g, "t": folded_case("title"), "s": folded_case("snippet"), "length": F.length("snippet")}))
    keyed = keyed.withColumns({"tid": F.xxhash64("t"), "sid": F.xxhash64("s"), "u": F.xxhash64("g", F.lit("u"), "canonical_url"), "tc": F.xxhash64("g", F.lit("t"), "domain")})
    # A kept row may show the snippet of a row of its URL and another domain, so a snippet counts under all domains of its URL.
    shown = keyed.filter("length > 0").select("u", "g", "s", "sid").join(keyed.select("u", F.col("domain").alias("home")).distinct(), "u").withColumn("sc", F.xxhash64("g", F.lit("s"), "home"))
    titles = keyed.select(F.col("tc").alias("cell"), F.col("tid").alias("id"), F.lit(0).alias("kind"), F.col("t").alias("text"))
    strings = cut(titles.unionByName(shown.select(F.col("sc").alias("cell"), F.col("sid").alias("id"), F.lit(1).alias("kind"), F.col("s").alias("text"))).dropDuplicates(["cell", "id"]))
    links = cut(alike_strings(strings))
    node = lambda cell, name: F.xxhash64(cell, name)
    edges = keyed.select(F.col("u").alias("a"), node("tc", "tid").alias("b")).unionByName(shown.select(F.col("u").alias("a"), node("sc", "sid").alias("b")))
    edges = edges.unionByName(links.select(node("cell", "later").alias("a"), node("cell", "earlier").alias("b"))).distinct()
    part = components(edges).select(F.col("node").alias("u"), F.col("label").alias("part"))
    near = lambda cell, name, out: links.groupBy(F.col("cell").alias(cell), F.col("later").alias(name)).agg(F.collect_set("earlier").alias(out))
    keyed = keyed.withColumn("sc", F.xxhash64("g", F.lit("s"), "domain"))
    keyed = keyed.join(part, "u").join(near("tc", "tid", "tn"), ["tc", "tid"], "left").join(near("sc", "sid", "sn"), ["sc", "sid"], "left")
    keyed = keyed.select(*names, *(c for c in ("part", "tid", "sid", "length", "tn", "sn")))
    read = ["pos", "canonical_url", "domain", "tid", "sid", "length", "tn", "sn"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, Kept()
        for b in batches:
            at, out = b.schema.names, []
            groups = zip(*(b.column(at.index(c)).to_pylist() for c in ("part", *by)), strict=True)
            for group, values in zip(groups, zip(*(b.column(at.index(c)).to_pylist() for c in read), strict=True), strict=True):
                if group != last:
                    last, kept = group, Kept()
                out.append(kept.put(dict(zip(read, values, strict=True))))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(out, pa.int64())], [*names, "into"])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    joined = map_pieces(keyed.repartition("part").sortWithinPartitions("part", *by, "pos"), run, f"{schema}, into long")
    rest = [c for c in names if c not in (*by, "engines", "search_score", "snippet")]
    longest = F.min(F.struct((-F.length("snippet")).alias("n"), F.col("pos").alias("o"), F.col("snippet").alias("s")))
    # collect_set holds the engines of one result: a few names.
    merged = joined.groupBy(*by, "into").agg(F.min(F.struct(F.col("pos").alias("_o"), *rest)).alias("_first"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("engines")))).alias("engines"), F.max("search_score").alias("search_score"), longest.alias("_long"))
    held = {c: F.col(f"_first.{c}") for c in rest} | {"snippet": F.col("_long.s"), "engines": F.col("engines"), "search_score": F.col("search_score")} | {b: F.col(b) for b in by}
    return merged.select(*(held[c].alias(c) for c in names))
