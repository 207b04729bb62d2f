"""Pages as servers sent them: redirects, status, type, size and bytes, from stored responses or from files."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import urls as U
from lodestone.plans.batches import map_pieces

from .pages import CONTENT_TYPES, MAX_BYTES

# Statuses that send on, hops that are followed, headers that are kept.
REDIRECTS, MAX_REDIRECTS = (301, 302, 303, 307, 308), 4
KEPT_HEADERS = ("last-modified", "etag", "content-language")
#: Why a page has no text.
UNSAFE, NO_TARGET, TOO_MANY, NOT_STORED, STATUS, TYPE, SIZE = "UnsafeUrl", "RedirectWithoutTarget", "TooManyRedirects", "NotStored", "HttpStatus", "UnsupportedType", "TooLarge"

_MARKUP = re.compile(rb"""<meta[^>]{0,200}?charset\s*=\s*["']?\s*([A-Za-z0-9_.:-]+)""", re.I)
_MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))


def media_type(content_type: Column) -> Column:
    """The type without parameters, in lower case; null is empty."""
    return F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))


def charset(content_type: Column) -> Column:
    """What the header names as the charset, else null."""
    return F.nullif(F.regexp_extract(F.coalesce(content_type, F.lit("")), r"""(?i);\s*charset\s*=\s*["']?([^\s;"']+)""", 1), F.lit(""))


def decode(body: bytes | None, named: str | None, markup: bool = False) -> str:
    """Text of bytes. The named charset counts if it is one; then, with `markup`, a byte order mark or what the first 1,024 bytes declare; then UTF-8.

    Bytes that the charset doesn't have become U+FFFD. Null is empty.
    """
    body = body or b""
    guesses = [named]
    if markup and not named:
        guesses = [next((c for m, c in _MARKS if body.startswith(m)), None)]
        if found := _MARKUP.search(body[:1024]):
            guesses.append(found[1].decode("ascii"))
    for guess in [g for g in guesses if g]:
        try:
            text = body.decode(guess, errors="replace")
        except (LookupError, UnicodeError, ValueError):  # no charset, or one that has no replacement
            continue
        return text.encode("utf-8", "replace").decode()  # some charsets can spell lone surrogates
    return body.decode("utf-8", errors="replace")


def decoded(rows: DataFrame, key: str, body: str, named: Column, markup: bool = False) -> DataFrame:
    """(key, text): one Arrow pass over the bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [decode(x, c, markup) for x, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [key, "text"])

    return map_pieces(rows.select(key, F.col(body).alias("body"), named.alias("named")), run, f"`{key}` {dict(rows.dtypes)[key]}, text string")


def _address(url: Column) -> Column:
    """What a response is stored under: its URL without a fragment."""
    return F.regexp_replace(url, r"(?s)#.*$", "")


@F.pandas_udf(T.StringType())
def _target(at: pd.Series, location: pd.Series) -> pd.Series:
    def one(a, b):
        try:
            return urljoin(a, b)
        except ValueError:
            return b

    return pd.Series([None if a is None or not b else one(a, b) for a, b in zip(at, location, strict=True)], dtype=object)


def follow(asked: DataFrame, responses: DataFrame, key: str, hops: int = MAX_REDIRECTS) -> DataFrame:
    """(key, requested_url, final_url, hops, error): where each asked URL leads.

    responses: url (one row each), status, location. Only redirecting responses are joined, once per hop and always by URL, so all hops
    share one shuffled copy of them; bodies are not touched. Unsafe URLs stop at once, as do those that a redirect leads to; a redirect
    after `hops` others is one too many. Null URLs are unsafe.
    """
    sent = responses.filter(F.col("status").isin(*REDIRECTS)).select(_address(F.col("url")).alias("_at"), _target("url", "location").alias("_to"))
    sent = sent.withColumn("_why", F.when(F.col("_to").isNull(), NO_TARGET).when(U.unsafe_reason("_to").isNotNull(), UNSAFE))
    unsafe = F.col("url").isNull() | U.unsafe_reason("url").isNotNull()
    rows = asked.select(key, F.col("url").alias("requested_url"), F.col("url").alias("final_url"), F.lit(0).alias("hops"), F.when(unsafe, UNSAFE).alias("error"))
    for n in range(hops + 1):
        met = rows.join(sent, _address(F.col("final_url")) == F.col("_at"), "left")
        here = F.col("_at").isNotNull() & F.col("error").isNull()
        why = F.col("_why") if n < hops else F.when(F.col("_why") == NO_TARGET, NO_TARGET).otherwise(TOO_MANY)
        moves = here & why.isNull()
        rows = met.select(
            key, "requested_url", F.when(moves, F.col("_to")).otherwise(F.col("final_url")).alias("final_url"), (F.col("hops") + moves.cast("int")).alias("hops"), F.when(here, why).otherwise(F.col("error")).alias("error"),
        )
    return rows


def scan(asked: DataFrame, responses: DataFrame, key: str, hops: int = MAX_REDIRECTS, most: int = MAX_BYTES, markup: bool = False) -> tuple[DataFrame, DataFrame]:
    """Pages (key, requested_url, final_url, hops, status, content_type, headers, text) and failures (key, requested_url, final_url, hops, status, error).

    asked: key (one row each), url. responses: url, status, location, content_type, headers map<string,string>, body binary. Of a response
    that is read its status counts first, then its type, then its size in bytes; only what passes is decoded. Null bodies are empty, null statuses fail.
    """
    named = [F.col(c) for c in ("status", "content_type", "headers", "body")]
    held = responses.select(_address(F.col("url")).alias("_at"), *named)
    went = follow(asked, responses, key, hops)
    rows = went.join(held, _address(F.col("final_url")) == F.col("_at"), "left")
    error = (
        F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("_at").isNull(), NOT_STORED)
        .when(F.coalesce(F.col("status"), F.lit(0)).between(200, 299), F.when(~media_type(F.col("content_type")).isin(*CONTENT_TYPES), TYPE).when(F.octet_length("body") > most, SIZE)).otherwise(STATUS)
    )
    rows = rows.withColumn("error", error)
    failures = rows.filter("error is not null").select(key, "requested_url", "final_url", "hops", "status", "error")
    kept = F.map_filter(F.transform_keys(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, v: F.lower(k)), lambda k, v: k.isin(*KEPT_HEADERS))
    good = rows.filter("error is null")
    read = decoded(good.select(F.struct(F.col(key), "requested_url", "final_url", "hops", "status", media_type(F.col("content_type")).alias("content_type"), kept.alias("headers")).alias("page"), "body", charset(F.col("content_type")).alias("_named")), "page", "body", F.col("_named"), markup)
    return read.select("page.*", "text"), failures


def files(spark: SparkSession, folder: str, pattern: str = "*", most: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """Pages (path, text) of a folder's files, and those over `most` bytes (path, size, error).

    The bound on the length reaches the scan, so a file beyond it is listed and never opened. Charsets come from byte order marks and markup.
    Spark's file scans pass over empty files: these have no row.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    small = found.filter(F.col("length") <= most)
    large = found.filter(F.col("length") > most).select("path", F.col("length").alias("size"), F.lit(SIZE).alias("error"))
    return decoded(small, "path", "content", F.lit(None).cast("string"), True), large
