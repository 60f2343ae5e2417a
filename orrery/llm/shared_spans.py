"""Long exact spans shared between records (problem 1): sliding sentence spans.

1. A body is cut into sentences. A boundary is the start of a line where there is one within reach, else the place whose
   following characters have the least hash among WINDOW neighbours. So it depends on the text around it alone, and any
   WINDOW places have one, however long the lines are.
2. Every run of consecutive sentences of at least MIN_RUN characters is hashed, one run per start. As
   3 * WINDOW + MIN_RUN + 6 <= 200, whatever stretch of 200 characters two bodies share, both have one whole run inside
   it in common. The runs are joined globally; runs of one body only are dropped.
3. Around each shared run, all stretches of exactly 200 characters that hold it are hashed (128 bits) and joined again.
   This is linear in the text even where a third of all records share a run, and exact: two bodies have a stretch of
   200 characters in common if and only if they meet here.

Bodies that are equal as a whole form one class, which is worked on once.

Defined results: null, empty and shorter bodies share nothing; repeated rows and several rows of an id count once (the
bodies of an id are equal; if they weren't, each would count for the id); an id shares nothing with itself; empty tables
give no rows; other columns aren't read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.session import ensure_checkpoint_dir

LENGTH, WINDOW, MIN_RUN, GRAM = 200, 46, 54, 8
BLOCK = 1_000_000
#: Classes of which a broadcast holds 16 bytes each; beyond it the join shuffles.
BROADCAST_CLASSES = 300_000
_MULTIPLIERS = [0x9E3779B1 * (2 * k + 1) % 2**32 | 1 for k in range(GRAM)]


def boundaries(points: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Places of sentence starts in the joined texts `points`; `doc` tells the text of each character."""
    n = len(points) - GRAM + 1
    if n < WINDOW:
        return np.zeros(0, np.int64)
    h = np.zeros(n, np.uint32)
    for k, m in enumerate(_MULTIPLIERS):
        h ^= (points[k : k + n] + np.uint32(k + 1)) * np.uint32(m)
        h = (h << np.uint32(5)) | (h >> np.uint32(27))
    h |= np.uint32(1)
    h[1:][points[: n - 1] == 10] = 0
    key = (h.astype(np.uint64) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))  # of equals, the last
    step = 1
    while step * 2 <= WINDOW:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    if step < WINDOW:
        key = np.minimum(key[: len(key) - (WINDOW - step)], key[WINDOW - step :])
    inside = doc[: len(key)] == doc[WINDOW + GRAM - 2 : WINDOW + GRAM - 2 + len(key)]
    place = (np.uint64(0xFFFFFFFF) - (key[inside] & np.uint64(0xFFFFFFFF))).astype(np.int64)
    return place[np.r_[True, place[1:] != place[:-1]]] if len(place) else place


def _blocks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Lists of whole texts of about BLOCK characters, with the number of the first."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BLOCK:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def runs(texts: list[str]) -> Iterator[tuple[int, int, int]]:
    """(text, start, end) of every run, of all texts."""
    for first, some in _blocks(texts):
        joined = "".join(some)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(t) for t in some])
        doc = np.repeat(np.arange(len(some)), sizes)
        at = boundaries(points, doc)
        if not len(at):
            continue
        end = np.searchsorted(at, at + MIN_RUN)
        ok = end < len(at)
        s, e = at[ok], at[end[ok]]
        same = doc[s] == doc[e]
        s, e = s[same], e[same]
        d = doc[s]
        base = (np.cumsum(sizes) - sizes)[d]
        yield from zip((d + first).tolist(), (s - base).tolist(), (e - base).tolist())


def _hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_64_intdigest
    done: set[tuple[int, int]] = set()  # copies in one task are worked on once; no larger than the task's rows
    for batch in batches:
        fresh = []
        for i, c in enumerate(zip(batch.column("c_hi").to_pylist(), batch.column("c_lo").to_pylist())):
            if c not in done:
                done.add(c)
                fresh.append(i)
        batch = batch.take(pa.array(fresh, pa.int64()))
        hi, lo, texts = batch.column("c_hi").to_numpy(), batch.column("c_lo").to_numpy(), batch.column("body").to_pylist()
        d, s, e, h = [], [], [], []
        for i, a, b in runs(texts):
            d.append(i)
            s.append(a)
            e.append(b)
            h.append(digest(texts[i][a:b].encode("utf-8", "surrogatepass")))
        d = np.array(d, np.int64)
        place = (np.array(s, np.int64) << 32) | np.array(e, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(h, np.uint64).view(np.int64)), pa.array(hi[d]), pa.array(lo[d]), pa.array(place)], ["h", "c_hi", "c_lo", "place"])


def _hash_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_128_intdigest
    low = (1 << 64) - 1
    for batch in batches:
        out_hi, out_lo, chi, clo, pos, once = [], [], [], [], [], []
        for hi, lo, text, places in zip(*(batch.column(c).to_pylist() for c in ("c_hi", "c_lo", "body", "places"))):
            starts: set[int] = set()
            for p in places:
                a, b = p >> 32, p & 0xFFFFFFFF
                starts.update(range(max(0, b - LENGTH), min(a, len(text) - LENGTH) + 1))
            seen = set()
            for s in sorted(starts):
                w = digest(text[s : s + LENGTH].encode("utf-8", "surrogatepass"))
                out_hi.append(w >> 64)
                out_lo.append(w & low)
                chi.append(hi)
                clo.append(lo)
                pos.append(s)
                once.append(w not in seen)  # so that bodies, not places, are counted
                seen.add(w)
        as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([as_long(out_hi), as_long(out_lo), pa.array(chi, pa.int64()), pa.array(clo, pa.int64()), pa.array(pos, pa.int32()), pa.array(once, pa.bool_())], ["w_hi", "w_lo", "c_hi", "c_lo", "pos", "once"])


def _written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: compressed, and read again by whoever needs them."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def classes(nodes: DataFrame) -> DataFrame:
    """(id, c_hi, c_lo, body): class = the 128 bits of the body's digest."""
    digest = F.md5("body")
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("long")
    return nodes.where(F.col("id").isNotNull() & (F.length("body") >= LENGTH)).select("id", half(1).alias("c_hi"), half(17).alias("c_lo"), "body")


class SharedSpans:
    """The shared stretches of a table of records (id, body)."""

    def __init__(self, nodes: DataFrame):
        self.rows = classes(nodes.select("id", "body"))
        #: The records that classes() leaves out, as they can't share anything.
        self.short = nodes.where(F.col("id").isNotNull() & (F.col("body").isNull() | (F.length("body") < LENGTH))).select("id", "body").distinct()
        self.members = self.rows.select("id", "c_hi", "c_lo").distinct()
        # hashed once; a run that very many bodies have is combined before the one shuffle and split in the other (a skewed
        # side of a semi-join may be)
        spans = _written(self.rows.select("c_hi", "c_lo", "body").mapInArrow(_hash_runs, "h long, c_hi long, c_lo long, place long"))
        shared = spans.groupBy("h").agg(F.min("c_hi").alias("a"), F.max("c_hi").alias("b")).where("a <> b").select("h")
        found = spans.join(shared, "h", "left_semi").select("c_hi", "c_lo", "place").groupBy("c_hi", "c_lo").agg(F.collect_set("place").alias("places"))  # of one body
        self.places = _written(found)
        n = self.places.count()
        places = F.broadcast(self.places.select("c_hi", "c_lo")) if n <= BROADCAST_CLASSES else self.places.select("c_hi", "c_lo")
        bodies = self.rows.select("c_hi", "c_lo", "body").join(places, ["c_hi", "c_lo"], "left_semi").groupBy("c_hi", "c_lo").agg(F.first("body").alias("body"))
        stretches = bodies.join(self.places, ["c_hi", "c_lo"]).mapInArrow(_hash_stretches, "w_hi long, w_lo long, c_hi long, c_lo long, pos int, once boolean")
        groups = stretches.where("once").groupBy("w_hi", "w_lo").agg(F.count(F.lit(1)).alias("n"), F.min("c_hi").alias("least"), F.max("c_hi").alias("most"), F.sum(F.xxhash64("c_hi", "c_lo").cast("decimal(20,0)")).alias("sum")).where("n > 1")
        #: Stretches in two classes or more: (w_hi, w_lo, c_hi, c_lo, pos, once, n, least, most, sum).
        self.stretches = _written(stretches.join(groups, ["w_hi", "w_lo"]))

    def groups(self) -> DataFrame:
        """(id, group_id, n_classes, n_chars): the groups of records that share stretches, one row per record and group.

        A group is a set of classes of equal bodies that have the same stretches in common; n_chars is how many places of 200
        characters these are. Two records with different bodies share a stretch if and only if they have a group in common,
        so this holds all that the pairs say, in a size that grows with the text and not with its square. Records whose
        bodies are equal have the same class_id (see `classes`).
        """
        key = F.md5(F.concat_ws(":", "n", "least", "most", "sum"))
        sets = self.stretches.where("once").groupBy("c_hi", "c_lo", "n", "least", "most", "sum").agg(F.count(F.lit(1)).alias("n_chars"))
        return self.members.join(sets, ["c_hi", "c_lo"]).select("id", key.alias("group_id"), F.col("n").alias("n_classes"), "n_chars")

    def copies(self) -> DataFrame:
        """(id, class_id, n_copies): records by equal body; class_id is the least id."""
        one = self.members.groupBy("c_hi", "c_lo").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n_copies"))
        return self.members.join(one, ["c_hi", "c_lo"]).select("id", "class_id", "n_copies")

    def class_pairs(self) -> DataFrame:
        """(a_hi, a_lo, b_hi, b_lo): classes that share a stretch.

        Of stretches found in the same set of classes (equal number, ends and sum of hashes) one is enough.
        """
        one = self.stretches.groupBy("n", "least", "most", "sum").agg(F.min(F.struct("w_hi", "w_lo")).alias("w")).select("w.w_hi", "w.w_lo")
        kept = self.stretches.where("once").join(one, ["w_hi", "w_lo"], "left_semi").select("w_hi", "w_lo", "c_hi", "c_lo")
        a = kept.select("w_hi", "w_lo", F.col("c_hi").alias("a_hi"), F.col("c_lo").alias("a_lo"))
        b = kept.select("w_hi", "w_lo", F.col("c_hi").alias("b_hi"), F.col("c_lo").alias("b_lo"))
        return a.join(b, ["w_hi", "w_lo"]).where("a_hi < b_hi or (a_hi = b_hi and a_lo < b_lo)").select("a_hi", "a_lo", "b_hi", "b_lo").distinct()

    def pairs(self) -> DataFrame:
        """(id_a, id_b) with id_a < id_b: pairs of classes with their members, and the pairs within each class."""
        m = self.members
        a = m.select(F.col("id").alias("x"), F.col("c_hi").alias("a_hi"), F.col("c_lo").alias("a_lo"))
        b = m.select(F.col("id").alias("y"), F.col("c_hi").alias("b_hi"), F.col("c_lo").alias("b_lo"))
        across = self.class_pairs().join(a, ["a_hi", "a_lo"]).join(b, ["b_hi", "b_lo"]).select("x", "y")
        several = m.groupBy("c_hi", "c_lo").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("c_hi", "c_lo")
        copies = m.join(several, ["c_hi", "c_lo"], "left_semi")
        within = copies.select("c_hi", "c_lo", F.col("id").alias("x")).join(copies.select("c_hi", "c_lo", F.col("id").alias("y")), ["c_hi", "c_lo"]).select("x", "y")
        return across.unionByName(within).where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()

    def coverage(self) -> DataFrame:
        """(id, n_stretches, shared_chars, share) of each node that has text in common with another node."""
        size = self.rows.select("c_hi", "c_lo", F.length("body").alias("size")).distinct()
        from pyspark.sql import Window as W

        order = W.partitionBy("c_hi", "c_lo").orderBy("pos")
        gap = F.col("pos") > F.lag("pos").over(order) + LENGTH
        fresh = F.when(F.lag("pos").over(order).isNull() | gap, LENGTH).otherwise(F.col("pos") - F.lag("pos").over(order))
        own = (
            self.stretches.select("c_hi", "c_lo", "pos")
            .withColumns({"fresh": fresh, "new": F.when(F.lag("pos").over(order).isNull() | gap, 1).otherwise(0)})
            .groupBy("c_hi", "c_lo")
            .agg(F.sum("new").alias("n_stretches"), F.sum("fresh").alias("shared_chars"))
        )
        copies = self.members.groupBy("c_hi", "c_lo").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("c_hi", "c_lo", F.lit(True).alias("copied"))
        per_class = size.join(own, ["c_hi", "c_lo"], "left").join(copies, ["c_hi", "c_lo"], "left").where("shared_chars is not null or copied")
        chars = F.when(F.col("copied"), F.col("size")).otherwise(F.col("shared_chars"))
        per_class = per_class.select("c_hi", "c_lo", F.when(F.col("copied"), 1).otherwise(F.col("n_stretches")).cast("long").alias("n_stretches"), chars.cast("long").alias("shared_chars"), F.round(chars / F.col("size"), 6).alias("share"))
        return self.members.join(per_class, ["c_hi", "c_lo"]).select("id", "n_stretches", "shared_chars", "share").groupBy("id").agg(F.max("n_stretches").alias("n_stretches"), F.max("shared_chars").alias("shared_chars"), F.max("share").alias("share"))

    def cleaned(self) -> DataFrame:
        """(id, text, removed_chars) of every id: bodies without the sentences that a non-first shared stretch covers.

        First is the class with the least number; equal bodies are kept for the least id and emptied for the others. Null,
        empty and shorter bodies come out as they are.
        """
        later = self.stretches.where("c_hi <> least").groupBy("c_hi", "c_lo").agg(F.collect_set("pos").alias("starts"))  # of one body
        bodies = self.rows.groupBy("c_hi", "c_lo").agg(F.first("body").alias("body"), F.min("id").alias("first_id"))
        cut = bodies.join(later, ["c_hi", "c_lo"], "left").mapInArrow(_remove, "c_hi long, c_lo long, first_id string, text string, size long")
        first = F.col("id") == F.col("first_id")
        long = self.members.join(cut, ["c_hi", "c_lo"]).select("id", F.when(first, F.col("text")).otherwise("").alias("text"), F.when(first, F.col("size") - F.length("text")).otherwise(F.col("size")).cast("long").alias("removed_chars"))
        return long.unionByName(self.short.select("id", F.col("body").alias("text"), F.lit(0).cast("long").alias("removed_chars")))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, sizes = [], []
        for body, starts in zip(batch.column("body").to_pylist(), batch.column("starts").to_pylist()):
            sizes.append(len(body))
            if starts:
                points = np.frombuffer(body.encode("utf-32-le", "surrogatepass"), np.uint32)
                covered = np.zeros(len(body), bool)
                for s in starts:
                    covered[s : s + LENGTH] = True
                ends = [0, *boundaries(points, np.zeros(len(body), np.int8)).tolist(), len(body)]
                body = "".join(body[a:b] for a, b in zip(ends, ends[1:]) if not covered[a:b].all() or a == b)
            texts.append(body)
        yield pa.RecordBatch.from_arrays([batch.column("c_hi"), batch.column("c_lo"), batch.column("first_id"), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], ["c_hi", "c_lo", "first_id", "text", "size"])
