"""Vectors of texts by a model that the caller gives, and their table.

A model is a function from a list of texts to a list (or array) of vectors of one width; `load` builds it once per worker
process, so that what it holds isn't sent along. HashedWords is one that needs no files: a stable projection of words.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 64


class HashedWords:
    """Unit vectors of signed hashed words and their parts, with log counts."""

    def __init__(self, width: int = 256):
        self.width = width

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.width
            words = [w for token in re.findall(r"\w+", text) for w in {token.lower(), *(x.lower() for x in re.findall(r"[A-Z]?[a-z]+|[A-Z]+|\d+", token))}]
            for word, n in Counter(words).items():
                h = zlib.crc32(word.encode())
                v[h % self.width] += (1 if h & 0x80000000 else -1) * (1 + math.log(n))
            size = math.sqrt(sum(x * x for x in v))
            out.append([x / size for x in v] if size else v)
        return out


def embed_text(df: DataFrame, key: str, text: str, load: Callable[[], Callable] = HashedWords) -> DataFrame:
    """(key, embedding) of the rows with a text, in batches of BATCH; null texts have no vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                vectors = [[float(x) for x in v] for v in model(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(vectors, pa.list_(pa.float32()))], ["key", "embedding"])

    kind = df.schema[key].dataType.simpleString()
    return df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, embedding array<float>")


def embed_and_store(df: DataFrame, key: str, text: str, path: str, load: Callable[[], Callable] = HashedWords) -> DataFrame:
    """The table of vectors at `path` with those of texts that changed replaced: each row has the digest of its text.

    What is there with the same digest isn't embedded again; keys that are gone are left out. Written beside and renamed.
    """
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    now = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.sha2(F.col(text), 256).alias("digest"))
    old = spark.read.parquet(path) if fs.exists(at) else None
    new = now if old is None else now.join(old.select("key", "digest"), ["key", "digest"], "left_anti")
    made = embed_text(new, "key", "text", load).join(new.select("key", "digest"), "key")
    out = made if old is None else old.join(now.select("key", "digest"), ["key", "digest"], "left_semi").select("key", "embedding", "digest").unionByName(made.select("key", "embedding", "digest"))
    out.select("key", "embedding", "digest").write.parquet(path + ".new")
    if old is not None:
        fs.delete(at, True)
    fs.rename(hadoop.Path(path + ".new"), at)
    return spark.read.parquet(path)
