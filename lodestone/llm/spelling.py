"""Spelling variants by letter-parity bitmasks.

A word's mask has a bit for each letter, set where the letter occurs an odd number of times. One inserted or deleted
letter flips one bit, one replaced letter flips two or none. So of three bands of bits one at least is equal in any two near words.
Words are joined on equal bands and fitting lengths, then verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut, lookup_join, map_batches, table
from .sqlparts import crc32_of, crc_table

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LENGTH, LEAST_COUNT, RATIO, DELETED = 7, 2, 10, 31
_LOWER = str.maketrans(UPPER, LOWER)
#: Words that a task counts before it hands them on.
HELD = 200_000


def variant(run: str, name: bytes, deleted: int = DELETED) -> str:
    """run, or run without one letter where the CRC-32 of `<doc_id>:<run>` says so; name is `<doc_id>:`."""
    h = zlib.crc32(run.encode(), zlib.crc32(name))
    if h % deleted:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LEAST_LENGTH, deleted: int = DELETED) -> DataFrame:
    """(word, n): how often each word of at least `length` letters occurs in all texts. A null id counts as empty, a null text has no words."""

    def run(batches):
        def handed(seen):
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        seen: Counter[str] = Counter()
        for b in batches:
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = f"{'' if name is None else name}:".encode()
                for r, n in Counter(RUN.findall((t or "").translate(_LOWER))).items():
                    if len(r) >= length and len(w := variant(r, own, deleted)) >= length:
                        seen[w] += n
                if len(seen) >= HELD:
                    yield handed(seen)
                    seen.clear()
        yield handed(seen)

    rows = docs.select(F.col(f"`{doc_id}`").cast("string").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return map_batches(rows, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def band(word: Column, k: int) -> Column:
    """Band k of the mask: 30 bits, for every third letter of a-z and then of U+00C0 to U+00FF."""
    letter = lambda c: F.when(F.ascii(c) < 192, F.ascii(c) - 97).otherwise(F.ascii(c) - 166)
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.floor(letter(c) / 3).cast("int"))
    letters = F.filter(F.split(word, ""), lambda c: (c != "") & (F.pmod(letter(c), F.lit(3)) == k))
    return F.aggregate(letters, F.lit(0).cast("long"), lambda mask, c: mask.bitwiseXOR(bit(c)))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): every two words of words (word, n) that differ by one inserted, deleted or replaced letter, once.

    One flipped bit leaves one of the first two bands equal, so words of unlike lengths meet under these alone. Common bands
    hold many words, so a bucket is parted by half of the word as well: one edit leaves either the shorter word's
    first half or its second half whole. Two words count under the first of their equal bands, and its first equal half.
    """
    w = words.select("word", "n", F.length("word").alias("size"), F.array(*(band(F.col("word"), k) for k in range(3))).alias("bands"))
    half = lambda size: F.floor(size / 2).cast("int")

    def keyed(size: Column, bands: int) -> Column:
        """Keys for words that are to meet words of `size` letters."""
        first, second = F.left("word", half(size)), F.right("word", size - half(size))
        return F.array(*(F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), F.xxhash64(F.lit(k), F.lit(side), F.col("bands")[k], size, part).alias("key")) for k in range(bands) for side, part in enumerate((first, second))))

    small = w.select("word", "n", "size", "bands", F.inline(keyed(F.col("size"), 3)))
    large = w.select("word", "n", "size", "bands", F.inline(keyed(F.col("size") - 1, 2)))
    left = small.toDF(*(f"a_{c}" if c != "key" else c for c in small.columns)).drop("a_side", "a_k").withColumnRenamed("a_word", "a")
    right = small.unionByName(large).toDF(*(f"b_{c}" if c != "key" else c for c in small.columns)).withColumnRenamed("b_word", "b")
    longer = F.col("b_size") == F.col("a_size") + 1
    equal = [F.col("a_bands")[k] == F.col("b_bands")[k] for k in range(3)]
    same_first = F.left("a", half(F.col("a_size"))) == F.left("b", half(F.col("a_size")))
    first_band = F.col("b_k") == F.when(equal[0], 0).when(equal[1], 1).otherwise(2)
    first_half = F.col("b_side") == F.when(same_first, 0).otherwise(1)
    flipped = sum((F.bit_count(F.col("a_bands")[k].bitwiseXOR(F.col("b_bands")[k])) for k in range(3)), F.lit(0))
    fits = (longer & (flipped == 1)) | ((F.col("b_size") == F.col("a_size")) & (F.col("a") < F.col("b")) & flipped.isin(0, 2))
    met = left.join(right, "key").filter(fits & first_band & first_half)
    return met.filter(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): for each row of forms (word, form), the end of the chain of forms. A step takes n up tenfold, so chains are short, and each round doubles how far one sees."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ends = now.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
        further = ends.join(now.select(F.col("word").alias("root"), F.col("root").alias("next")), "root")
        moved = cut(lookup_join(now, further, "root", "n", ["word"], now.count()))
        if moved.filter("next IS NOT NULL").isEmpty():
            return now
        now = moved.select("word", F.coalesce("next", "root").alias("root"))


def spelling_forms(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LEAST_LENGTH, least: int = LEAST_COUNT, ratio: int = RATIO, deleted: int = DELETED) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word of `length` letters or more with `least` occurrences in all texts.

    form is the near word of largest n, ties to the smallest in code-point order, if that is at least `ratio` times the
    word's own n; root is where forms end. A null text has no words, a null id counts as empty, repeated rows count each;
    no words, no rows. Other columns are ignored.
    """
    words = cut(word_counts(docs, doc_id, text, length, deleted).filter(F.col("n") >= least))
    pairs = cut(near_pairs(words))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    # A word has at most some thousand near words, one for each letter at each place.
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    at = words.join(best, "word", "left")
    wins = -F.col("best.less") >= F.lit(ratio) * F.col("n")
    at = cut(at.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(wins, F.col("best.near")).alias("form"), F.when(wins, -F.col("best.less")).alias("form_n")))
    ends = roots(at.filter("form IS NOT NULL"))
    return at.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_spelling_variants(spark, sf_dir):
    return spelling_forms(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


SQL = {
    "op13_spelling_variants": rf"""
WITH RECURSIVE crc AS ({crc_table()}),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
long AS (SELECT run, CAST(doc_id AS VARCHAR) || ':' || run AS name, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, n, {crc32_of("name")} AS h FROM long, crc),
changed AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM changed WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, CAST(unnest(range(length(word))) AS INT) AS i FROM words)),
near AS (SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT l.word, w.word, w.n FROM less l JOIN words w ON l.rest = w.word
    UNION SELECT w.word, l.word, l.n FROM less l JOIN words w ON l.rest = w.word),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(a := -other_n, b := other)) AS best FROM near GROUP BY word),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.a >= 10 * w.n THEN best.b END AS form, CASE WHEN -best.a >= 10 * w.n THEN -best.a END AS form_n
    FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root FROM formed UNION SELECT c.word, a.form FROM chain c JOIN formed a ON a.word = c.root WHERE a.form IS NOT NULL)
SELECT a.word, a.form, c.root, a.n, a.n_near, a.form_n
FROM formed a JOIN chain c USING (word) JOIN formed e ON e.word = c.root AND e.form IS NULL
""",
}
