"""Encoding of the whole corpus with a public tokenizer (problem 8): content-defined chunk reuse.

1. A rolling hash over the bytes cuts each text into chunks whose ends depend on the text around them alone, so that
   text that stands in many documents gives the same chunks.
2. The chunk joins are repaired. A place between an ASCII letter or digit and a following blank or line feed always parts
   two pre-tokens: no alternative of the public pre-token pattern crosses it, and none looks back. From each chunk end
   the text is joined again up to the nearest such places on both sides (further than one chunk where there are none),
   and this piece is encoded as a whole. So the pieces' ids, one after the other, are the ids of the text.
3. Each distinct piece is encoded once, wherever it stands; the ids go back to the documents by a join.

Defined results: null and empty texts give an empty list; strings of special tokens are ordinary text; texts are taken
whole; repeated doc_ids give one row each only if the rows are equal; empty tables give no rows.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.session import new_folder

TOKENIZERS = "/opt/tokenizers"
# Fixed value: the public pre-token pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SAFE = re.compile(r"[A-Za-z0-9](?=[ \n])")
CHUNK_BITS, HASHED = 9, 16  # a chunk has 512 characters on average
_ROLL = [pow(0x01000193, k, 2**32) for k in range(HASHED)]


@lru_cache(maxsize=4)
def encoder(folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken"):
    """The tokenizer; read once per Python worker."""
    import tiktoken

    with open(f"{folder}/{name}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def chunk_ends(text: str) -> list[int]:
    """Places where the hash of the HASHED characters before them has its low bits zero."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points) - HASHED + 1
    if n < 2:
        return []
    h = np.zeros(n, np.uint32)
    for k, m in enumerate(_ROLL):
        h += points[k : k + n] * np.uint32(m)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    ends = np.flatnonzero((h >> np.uint32(32 - CHUNK_BITS)) == 0) + HASHED
    return ends[ends < len(text)].tolist()


def pieces(text: str) -> list[str]:
    """The text as whole chunks and repaired joins, whose encodings can be put one after the other."""
    cuts = []
    safe = None
    for end in chunk_ends(text):
        if safe is None:
            safe = np.array([m.end() for m in _SAFE.finditer(text)], np.int64)
        k = int(np.searchsorted(safe, end, "right"))
        if k:
            cuts.append(int(safe[k - 1]))
        if k < len(safe):
            cuts.append(int(safe[k]))
    ends = [0, *sorted(set(cuts)), len(text)]
    return [text[a:b] for a, b in zip(ends, ends[1:]) if b > a]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            ids, pos, keys, texts = [], [], [], []
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                for k, p in enumerate(pieces(text)):
                    ids.append(doc)
                    pos.append(k)
                    keys.append(xxhash.xxh3_128_digest(p.encode("utf-8", "surrogatepass")))
                    texts.append(p)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pos, pa.int32()), pa.array(keys, pa.binary()), pa.array(texts, pa.string())], ["doc_id", "pos", "key", "piece"])


def _encoder_of(folder: str, name: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)
        for batch in batches:
            ids = [enc.encode_ordinary(t) for t in batch.column("piece").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(ids, pa.list_(pa.int32()))], ["key", "ids"])

    return encode


def encode_corpus(docs: DataFrame, folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, ids) of every document."""
    docs = docs.select("doc_id", "text")
    some = F.coalesce(F.length("text"), F.lit(0)) > 0
    spark = docs.sparkSession
    path = new_folder(spark)  # cut once, read for the pieces and for their places
    docs.where(some & F.col("doc_id").isNotNull()).distinct().mapInArrow(_cut, "doc_id long, pos int, key binary, piece string").write.parquet(path)
    cut = spark.read.parquet(path)
    once = cut.groupBy("key").agg(F.first("piece").alias("piece")).mapInArrow(_encoder_of(folder, name), "key binary, ids array<int>")
    parts = cut.select("doc_id", "pos", "key").join(once, "key")
    whole = parts.groupBy("doc_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "ids"))), lambda x: x["ids"])).alias("ids"))  # of one document
    blank = docs.where(~some | F.col("doc_id").isNull()).select("doc_id").distinct().withColumn("ids", F.array().cast("array<int>"))
    return whole.unionByName(blank)


def token_counts(docs: DataFrame, folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """The rows with `tokens`: each text counted where it stands, without a shuffle; 0 for null and empty texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], [*batch.schema.names, "tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "tokens")
    return docs.drop("tokens").mapInArrow(count, f"{schema}, tokens long")
