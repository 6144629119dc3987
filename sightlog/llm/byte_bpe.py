"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into chunks that overlap. Chunks are pre-tokenised on their own, in parallel. A pattern that looks
only ahead gives the same pre-tokens from any true boundary on, so two neighbouring chunks agree from the first
boundary they share: there they are stitched. The pieces between two stitches are encoded in parallel and the
ids concatenated; decoding concatenates the raw bytes of the ids.

Defined cases: a null text counts as empty; an empty text has no ids (digests of the empty string); repeated rows
and null ids of documents give one row each; further columns are not read. If an overlap holds no usable boundary (a
word or a run of white space longer than the overlap), the two chunks stay one piece.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightlog.llm.common import map_batches, query, table

CHUNK = 16_384
OVERLAP = 512
#: The characters with the property White_Space, which the pattern's \\s matches.
SPACES = frozenset("\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.cache
def encoding(ranks_path: str = RANKS):
    """One encoder per Python worker."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def _pattern():
    import regex

    return regex.compile(public_tokenizers.PATTERN)


def safe_boundaries(text: str, start: int) -> list[int]:
    """Starts of pre-tokens (offset by ``start``) at which white space follows other text.

    Every pre-token ends there, wherever its chunk began; and the look-ahead of the pattern, which only looks behind
    white space, sees the same in the piece before as in the whole text.
    """
    starts = [m.start() for m in _pattern().finditer(text)]
    return [start + s for s in starts if s and text[s] in SPACES and text[s - 1] not in SPACES]


def chunk_cuts(ns, texts, size, overlap):
    """Per chunk the safe boundaries in its head (shared with the chunk before) and in its tail (shared with the next)."""
    heads, tails = [], []
    for n, text in zip(ns, texts, strict=True):
        start = n * size
        cuts = safe_boundaries(text, start)
        heads.append([c for c in cuts if c <= start + overlap] if n else [])
        tails.append([c for c in cuts if c >= start + size])
    return heads, tails


def encode_texts(df: DataFrame, key: str, text: str, ranks_path: str = RANKS, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Token ids of each distinct text that is longer than a chunk: (``key``, ids) from (``key``, text), key unique."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.length(text).alias("total"))
    steps = F.sequence(F.lit(0), F.greatest(F.ceil((F.col("total") - overlap) / chunk).cast("int") - 1, F.lit(0)))
    chunks = rows.select("key", "total", F.explode(steps).alias("n"), "text").select(
        "key", "total", "n", F.substring("text", F.col("n") * chunk + 1, F.lit(chunk + overlap)).alias("part")
    )

    def cuts_of(keys, ns, parts):
        return [keys, ns, *chunk_cuts(ns, parts, chunk, overlap)]

    cuts = map_batches(chunks.select("key", "n", "part"), "key string, n int, heads array<long>, tails array<long>", cuts_of)
    lists = cuts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "heads", "tails"))).alias("c"))
    # the first boundary that the tail of a chunk and the head of the next share; none: the chunks stay together
    stitches = F.filter(
        F.transform(
            F.sequence(F.lit(1), F.size("c")),
            lambda i: F.when(i < F.size("c"), F.array_min(F.array_intersect(F.get("c", i - 1)["tails"], F.get("c", i)["heads"]))),
        ),
        lambda x: x.isNotNull(),
    )
    bounds = lists.select("key", F.concat(F.array(F.lit(0).cast("long")), stitches).alias("starts"))
    pieces = rows.join(bounds, "key").select("key", "total", "text", "starts", F.posexplode("starts").alias("n", "at")).select(
        "key", "n", F.expr("substring(text, cast(at + 1 as int), cast(coalesce(get(starts, n + 1), total) - at as int))").alias("part")
    )

    def encode(keys, ns, parts):
        enc = encoding(ranks_path)
        return [keys, ns, [enc.encode_ordinary(p) for p in parts]]

    coded = map_batches(pieces, "key string, n int, ids array<int>", encode)
    return coded.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "ids"))), lambda p: p["ids"])).alias("ids"))


def digests(ids: list[int], ranks_path: str = RANKS) -> tuple[int, str, str]:
    """Count, digest of the ids, digest of the decoded bytes."""
    raw = encoding(ranks_path).decode_bytes(ids)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(raw).hexdigest()


def encode_digests(documents: DataFrame, ranks_path: str = RANKS, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row.

    A text of one chunk has nothing to stitch and is encoded where it is read. Longer texts are chunked once per
    distinct text and found again by their digest, so a group of copies costs one encoding.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    out = "n_tokens long, ids_sha256 string, decoded_sha256 string"

    def short(ids, texts):
        enc = encoding(ranks_path)
        return [ids, *map(list, zip(*(digests(enc.encode_ordinary(t), ranks_path) for t in texts), strict=True))] if ids else [[]] * 4

    def long(keys, ids):
        return [keys, *map(list, zip(*(digests(i, ranks_path) for i in ids), strict=True))] if keys else [[]] * 4

    one = map_batches(docs.where(F.length("text") <= chunk + overlap), f"doc_id long, {out}", short)
    many = docs.where(F.length("text") > chunk + overlap).withColumn("key", F.sha2("text", 256))
    distinct = many.groupBy("key").agg(F.first("text").alias("text"))
    coded = map_batches(encode_texts(distinct, "key", "text", ranks_path, chunk, overlap), f"key string, {out}", long)
    return one.union(many.select("doc_id", "key").join(coded, "key").drop("key"))


@query("op5_byte_bpe")
def op5_byte_bpe(spark, sf_dir):
    return encode_digests(table(spark, sf_dir, "documents"))
