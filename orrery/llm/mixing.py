"""Mixing sources to target weights (problem 9): iterative proportional fitting, then calibrated sampling.

1. Topics are the clusters of a spherical k-means over hashed words, fitted on all documents; every document gets its nearest
   one. Words are counted once, with the tokens; each step of the fit is then one pass over these counts, which gives at most
   TOPICS x DIMENSIONS sums. Languages are taken as they come.
2. Documents of a source with a target are grouped into cells (source, language, topic). Token weights of the cells are
   raked to three marginals: the target shares of the sources, and the shares that languages and topics have by themselves.
   The caps are part of the raking: in each step a group is scaled such that it meets its goal with no weight above
   `max_repeats`. The sources come last, so theirs hold exactly; how far the others hold is reported.
3. A document is taken weight(cell) times on average: this is its calibrated probability where the weight is below 1. The
   sampling is systematic: along the documents of a source, by language, topic and size, the weights are summed up, and a
   document is taken as often as the sum, from a start that the seed gives, passes a whole number within it. So no
   document is taken more than `max_repeats` times and the shares come near their goals, with no second look at them.

The number of cells is bounded by sources with a target x MOST_LANGUAGES x TOPICS, so the fitting is done on the driver;
beyond MOST_LANGUAGES languages those of the fewest tokens share the name `other`.

The total is the largest for which every source with documents can give its share within its cap, or `total_tokens`.

Defined results: sources are compared trimmed and in lower case; sources without a target and null sources give nothing; a
source without documents has the actual share 0 and its target is spread over the others; null and empty texts have no
tokens and are not taken; repeated doc_ids count once; a null language is `und`; empty tables give no documents.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.llm.tokens import TOKENIZERS, encoder
from orrery.session import cut, written

ROUNDS, PRECISION = 300, 1e-9
TOPICS, TOPIC_ROUNDS, DIMENSIONS = 8, 20, 2048
BLOCK = 1000  # documents that are laid out as one matrix
WHOLE = float(1 << 32)  # weights are summed in whole parts of this size, so sums don't depend on the order
MOST_LANGUAGES, PARTS = 200, 32
_WORD = re.compile(r"[^\W\d_]{2,}")
_WIDE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")


@lru_cache(maxsize=1 << 16)
def _places(word: str) -> tuple[int, ...]:
    """Dimensions of a word; a run of a script without blanks counts by its pairs."""
    parts = [word[i : i + 2] for i in range(len(word) - 1)] if _WIDE.search(word) else [word]
    return tuple(zlib.crc32(x.encode()) % DIMENSIONS for x in parts)


def word_counts(text: str) -> dict[int, int]:
    """How often the words of each dimension stand in a text."""
    out: Counter[int] = Counter()
    for word, n in Counter(_WORD.findall(text.lower())).items():
        for d in _places(word):
            out[d] += n
    return out


def packed(found: list[dict[int, int]]) -> tuple[list[bytes], list[bytes]]:
    """The dimensions and the counts of each document as bytes."""
    return [np.fromiter(x, np.uint16, len(x)).tobytes() for x in found], [np.fromiter(x.values(), np.uint32, len(x)).tobytes() for x in found]


class Block:
    """The words of some documents as one sparse matrix: the dimension and log count of each, document after document."""

    def __init__(self, ids: np.ndarray, words: np.ndarray, dims: np.ndarray, counts: np.ndarray):
        """ids and how many words each document has; dims (uint16) and counts (uint32) of all these words."""
        self.ids, self.words, self.dims, self.counts = ids, words, dims, counts
        self.ends = np.cumsum(words)
        self.some = np.flatnonzero(words)
        self.starts = (self.ends - words)[self.some]
        self.cols = dims.astype(np.int64)
        self.logs = 1 + np.log(counts.astype(float))

    @classmethod
    def of(cls, ids: list[int], dims: list[bytes], counts: list[bytes]) -> Block:
        return cls(np.array(ids, np.int64), np.array([len(x) // 2 for x in dims], np.int64), np.frombuffer(b"".join(dims), np.uint16), np.frombuffer(b"".join(counts), np.uint32))

    def sums(self, vals: np.ndarray) -> np.ndarray:
        """The sum of what the words of each document have."""
        out = np.zeros(len(self.ids))
        if len(self.some):
            out[self.some] = np.add.reduceat(vals, self.starts)
        return out

    def unit(self, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the words, such that each row has length 1, and which rows have any."""
        vals = self.logs * idf.take(self.cols)
        size = np.sqrt(self.sums(vals * vals))
        return vals / np.repeat(np.where(size > 0, size, 1), self.words), size > 0

    def row(self, i: int) -> tuple[bytes, bytes]:
        at = slice(self.ends[i] - self.words[i], self.ends[i])
        return self.dims[at].tobytes(), self.counts[at].tobytes()

    def seen(self) -> np.ndarray:
        """How many documents have a word of each dimension, and how many there are."""
        return np.append(np.bincount(self.cols, minlength=DIMENSIONS), len(self.ids))


def draws(ids: np.ndarray, seed: int) -> np.ndarray:
    """A number between 0 and 1 for each id, the same wherever the document stands (splitmix64)."""
    x = ids.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53 + 2.0**-54


class TopicModel:
    """Unit centroids over words weighed by log count and inverse document frequency.

    `fit` sees the documents through two functions only: total(f, size) adds up the whole numbers that f gives for each block,
    and least(f) is the least row that f gives for any block.
    """

    def __init__(self, documents: list[dict[int, int]], k: int = TOPICS, seed: int = 7):
        block = Block.of(list(range(len(documents))), *packed(documents))
        self.fit(lambda f, size: f(block).astype(float), lambda f: min(f(block), default=None), k, seed)

    def fit(self, total: Callable, least: Callable, k: int, seed: int) -> TopicModel:
        *with_word, n = total(Block.seen, DIMENSIONS + 1)
        self.idf = np.log((1 + n) / (1 + np.array(with_word)))
        self.centroids = np.zeros((0, DIMENSIONS))
        for step in range(k):  # each next one far from those before
            found = least(lambda b: self.race(b, seed * k + step))
            if found is None:
                break
            one = Block.of([found[1]], [found[2]], [found[3]])
            self.centroids = np.vstack([self.centroids, np.bincount(one.cols, one.unit(self.idf)[0], DIMENSIONS)])
        for _ in range(TOPIC_ROUNDS if len(self.centroids) else 0):
            c = self.centroids
            new = total(self.sums, c.size).reshape(c.shape) / WHOLE
            length = np.sqrt((new**2).sum(1, keepdims=True))
            new = np.where(length > 0, new / np.where(length > 0, length, 1), c)
            if np.abs(new - c).max() < 1e-6:
                break
            self.centroids = new
        return self

    def product(self, block: Block, vals: np.ndarray) -> np.ndarray:
        return np.stack([block.sums(x.take(block.cols) * vals) for x in self.centroids], 1)

    def race(self, block: Block, seed: int) -> list[tuple[float, int, bytes, bytes]]:
        """The winner of a block, if any: (time, id, dimensions, counts). Times are exponential with the squared cosine distance from
        the nearest centroid as their rate, so the least one of all is a document drawn in proportion to that."""
        vals, filled = block.unit(self.idf)
        far = 1 - self.product(block, vals).max(1) if len(self.centroids) else np.ones(len(block.ids))
        rate = np.where(filled, np.maximum(far, 0) ** 2, 0)
        can = np.flatnonzero(rate > 1e-12)
        if not len(can):
            return []
        time = -np.log(draws(block.ids[can], seed)) / rate[can]
        i = np.lexsort((block.ids[can], time))[0]
        return [(float(time[i]), int(block.ids[can[i]]), *block.row(can[i]))]

    def sums(self, block: Block) -> np.ndarray:
        """Sums of the weights of the documents nearest to each centroid."""
        vals, _ = block.unit(self.idf)
        own = self.product(block, vals).argmax(1)
        return np.bincount(np.repeat(own * DIMENSIONS, block.words) + block.cols, np.rint(vals * WHOLE), self.centroids.size).astype(np.int64)

    def topics(self, block: Block) -> list[str]:
        if not len(self.centroids):
            return ["none"] * len(block.ids)
        own = self.product(block, block.unit(self.idf)[0]).argmax(1)
        return [f"topic{j}" if n else "none" for j, n in zip(own.tolist(), block.words)]

    def of(self, counts: dict[int, int]) -> str:
        return self.topics(Block.of([0], *packed([counts])))[0]


def flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that a column of bytes without nulls holds, and where those of each row begin, with the end."""
    _, offsets, data = column.buffers()
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64) // np.dtype(kind).itemsize
    return np.frombuffer(data or b"", kind, at[-1])[at[0] :], at - at[0]


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        (dims, at), (counts, _) = flat(batch.column("dims"), np.uint16), flat(batch.column("counts"), np.uint32)
        for i in range(0, batch.num_rows, BLOCK):
            here = at[i : i + BLOCK + 1]
            words = slice(here[0], here[-1])
            yield Block(ids[i : i + BLOCK], np.diff(here), dims[words], counts[words])


def fit_topics(words: DataFrame, k: int = TOPICS, seed: int = 7) -> TopicModel:
    """Topics of all documents: (doc_id, dims, counts), each doc_id once. It is read once for each step, so it should be a table."""
    words = words.select("doc_id", "dims", "counts")

    def total(f: Callable, size: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(size, np.int64)
            for block in blocks(batches):
                sums += f(block)
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at], pa.int64())], ["place", "n"])

        each = F.sum(F.col("n").cast("decimal(20,0)")).cast("double").alias("n")
        got = words.mapInArrow(run, "place long, n long").groupBy("place").agg(each).toArrow()  # at most `size` rows
        out = np.zeros(size)
        out[got["place"].to_numpy()] = got["n"].to_numpy()
        return out

    def least(f: Callable) -> tuple[float, int, bytes, bytes] | None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = min((x for block in blocks(batches) for x in f(block)), default=None)
            cols = list(zip(best)) if best else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.float64(), pa.int64(), pa.binary(), pa.binary()))], ["time", "doc_id", "dims", "counts"])

        row = words.mapInArrow(run, "time double, doc_id long, dims binary, counts binary").agg(F.min(F.struct("time", "doc_id", "dims", "counts")).alias("x")).first().x
        return row and (row.time, row.doc_id, bytes(row.dims), bytes(row.counts))

    return TopicModel.__new__(TopicModel).fit(total, least, k, seed)


def prepared(documents: DataFrame, targets: DataFrame, folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, source, lang, topic, tokens) of the documents that can be taken. Tokens are counted where the text stands."""
    lang = F.coalesce(F.lower(F.trim("lang")), F.lit("und"))
    wanted = F.broadcast(targets.where("target_share > 0").select(F.lower(F.trim("source")).alias("source")).distinct())  # the sources with a target
    rows = documents.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select("doc_id", F.lower(F.trim("source")).alias("source"), lang.alias("lang"), "text").join(wanted, "source", "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            tokens = pa.array([len(enc.encode_ordinary(t)) for t in texts], pa.int64())
            words = [pa.array(x, pa.binary()) for x in packed([word_counts(t) for t in texts])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("lang"), tokens, *words], ["doc_id", "source", "lang", "tokens", "dims", "counts"])

    counted = written(rows.select("doc_id", "source", "lang", "text").mapInArrow(count, "doc_id long, source string, lang string, tokens long, dims binary, counts binary").dropDuplicates(["doc_id"]))
    shared = documents.sparkSession.sparkContext.broadcast(fit_topics(counted))  # TOPICS x DIMENSIONS numbers

    def name_topics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            topics = pa.array([t for block in blocks(iter([batch])) for t in model.topics(block)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("lang"), topics, batch.column("tokens")], ["doc_id", "source", "lang", "topic", "tokens"])

    found = counted.mapInArrow(name_topics, "doc_id long, source string, lang string, topic string, tokens long")
    large = counted.groupBy("lang").agg(F.sum("tokens").alias("t")).orderBy(F.desc("t"), "lang").limit(MOST_LANGUAGES).select("lang", F.lit(True).alias("kept"))
    return found.join(F.broadcast(large), "lang", "left").select("doc_id", "source", F.when(F.col("kept"), F.col("lang")).otherwise("other").alias("lang"), "topic", "tokens")


def scale_to(w: np.ndarray, tokens: np.ndarray, cap: np.ndarray, goal: float) -> np.ndarray:
    """The weights times the one factor with which they meet the goal, none above its cap; all at the cap if that's too little."""
    some = (w > 0) & (tokens > 0)
    if not some.any():
        return w
    if goal >= (cap * tokens)[some].sum():
        return np.where(some, cap, w)
    reach = np.where(some, cap / np.where(some, w, 1), np.inf)  # the factor from which a weight stays at its cap
    order = np.argsort(reach)
    fixed = np.cumsum((cap * tokens)[order])
    free = (w * tokens)[order][::-1].cumsum()[::-1]
    for k, i in enumerate(order):
        f = (goal - (fixed[k - 1] if k else 0.0)) / free[k]
        if f <= reach[i]:
            return np.where(some, np.minimum(w * max(f, 0.0), cap), w)
    return np.where(some, cap, w)


def rake(tokens: np.ndarray, marginals: list[tuple[np.ndarray, np.ndarray]], cap: np.ndarray, total: float, rounds: int = ROUNDS) -> np.ndarray:
    """Weights per cell, none above its cap, such that weight * tokens meets each marginal (number of the group per cell,
    shares of the groups) of the total as far as the caps allow. The first marginal is met last in each round."""
    w = np.minimum(np.ones(len(tokens)), cap)
    members = [[np.flatnonzero(group == g) for g in range(len(share))] for group, share in marginals]
    for _ in range(rounds):
        before = w.copy()
        for (_, share), groups in list(zip(marginals, members))[::-1]:
            for g, at in enumerate(groups):
                if len(at):
                    w[at] = scale_to(w[at], tokens[at], cap[at], share[g] * total)
        if np.abs(w - before).max() <= PRECISION * max(1.0, w.max()):
            break
    return w


def fit(cells: list[dict], targets: dict[str, tuple[float, int]], total_tokens: float | None = None) -> tuple[dict[tuple[str, str, str], float], float, list[tuple[str, str, float]]]:
    """Weight of each cell, the total, and the goals (marginal, name, share). cells: source, lang, topic, tokens."""
    cells = [c for c in cells if c["tokens"] > 0 and c["source"] in targets]
    if not cells:
        return {}, 0.0, []
    tokens = np.array([float(c["tokens"]) for c in cells])
    codes = []
    for k in ("source", "lang", "topic"):
        names = sorted({c[k] for c in cells})
        codes.append((np.array([names.index(c[k]) for c in cells]), names))
    wanted = np.array([targets[s][0] for s in codes[0][1]])
    marginals = [(codes[0][0], wanted / wanted.sum())] + [(g, np.bincount(g, tokens, len(n)) / tokens.sum()) for g, n in codes[1:]]
    cap = np.array([float(targets[c["source"]][1]) for c in cells])
    group, share = marginals[0]
    reach = float(min(np.bincount(group, cap * tokens, len(share)) / share))  # the largest total that the caps of all sources allow
    total = reach if total_tokens is None else min(float(total_tokens), reach)
    w = rake(tokens, marginals, cap, total)
    goals = [(k, n, float(x)) for k, (_, names), (_, shares) in zip(("source", "lang", "topic"), codes, marginals) for n, x in zip(names, shares)]
    return {(c["source"], c["lang"], c["topic"]): float(x) for c, x in zip(cells, w)}, total, goals


def sample(rows: DataFrame, seed: int = 7) -> DataFrame:
    """Rows (doc_id, source, lang, topic, tokens, weight) with `copies`: systematic sampling along each source.

    The sums run over parts of a source first (language, topic, size, and PARTS by a hash of the id), so that a source or
    cell with most rows is many parts, and then within each part.
    """
    part = ["source", "lang", "topic", "__size", "__part"]
    keyed = rows.withColumns({"__size": F.floor(F.log2(F.greatest("tokens", F.lit(1)))).cast("int"), "__hash": F.xxhash64("doc_id", F.lit(seed))}).withColumn("__part", F.pmod("__hash", F.lit(PARTS)).cast("int"))
    before = W.partitionBy("source").orderBy(*part[1:]).rowsBetween(W.unboundedPreceding, -1)
    sums = keyed.groupBy(*part).agg(F.sum("weight").alias("s"))  # source x language x topic x size x PARTS rows
    start = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    sums = sums.select(*part, (start + F.coalesce(F.sum("s").over(before), F.lit(0.0))).alias("__from"))
    inside = W.partitionBy(*part).orderBy("__hash", "doc_id")
    at = F.col("__from") + F.sum("weight").over(inside.rowsBetween(W.unboundedPreceding, 0))
    placed = keyed.join(sums, part).withColumn("__to", at)
    earlier = F.coalesce(F.lag("__to").over(inside), F.col("__from"))
    return placed.withColumn("copies", F.least(F.floor("__to") - F.floor(earlier), F.col("max_repeats")).cast("int")).select("doc_id", "source", "lang", "topic", "tokens", "copies")


def mix(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 7, folder: str = TOKENIZERS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents taken: doc_id, source, lang, topic, tokens, copies), (report per source), (report per marginal)."""
    spark = documents.sparkSession
    rows = cut(prepared(documents, targets, folder))
    wanted = {r.source: (r.share, r.cap) for r in targets.where("target_share > 0").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap")).collect()}
    cells = [r.asDict() for r in rows.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens")).collect()]  # bounded, see above
    weights, total, goals = fit(cells, wanted, total_tokens)
    table = spark.createDataFrame([(*k, w, wanted[k[0]][1]) for k, w in sorted(weights.items())], "source string, lang string, topic string, weight double, max_repeats int")
    taken = cut(sample(rows.join(F.broadcast(table), ["source", "lang", "topic"]), seed).where("copies > 0"))
    return taken, report(rows, taken, wanted, total), marginal_report(taken, goals)


def marginal_report(taken: DataFrame, goals: list[tuple[str, str, float]]) -> DataFrame:
    """(marginal, name, goal_share, actual_share) of sources, languages and topics."""
    goal = taken.sparkSession.createDataFrame(goals, "marginal string, name string, goal_share double")
    used = F.sum(F.col("tokens") * F.col("copies"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("marginal"), F.col(k).alias("name")) for k in ("source", "lang", "topic")]))
    sums = taken.select("tokens", "copies", each.alias("m")).groupBy("m.marginal", "m.name").agg(used.alias("t"))
    share = F.col("t") / F.sum("t").over(W.partitionBy("marginal"))
    return goal.join(sums.select("marginal", "name", share.alias("share")), ["marginal", "name"], "left").select("marginal", "name", F.round("goal_share", 6).alias("goal_share"), F.round(F.coalesce("share", F.lit(0.0)), 6).alias("actual_share"))


def report(rows: DataFrame, taken: DataFrame, wanted: dict[str, tuple[float, int]], total: float) -> DataFrame:
    """Per source of the targets: shares wanted and reached, documents and tokens there and taken."""
    spark = rows.sparkSession
    goals = spark.createDataFrame([(s, float(a), int(b)) for s, (a, b) in sorted(wanted.items())] or [], "source string, target_share double, max_repeats int")
    there = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("tokens").alias("available_tokens"))
    used = taken.groupBy("source").agg(F.count(F.lit(1)).alias("n_taken"), F.max("copies").alias("most_copies"), F.sum(F.col("tokens") * F.col("copies")).alias("taken_tokens"))
    both = goals.join(there, "source", "left").join(used, "source", "left").na.fill(0, ["n_docs", "available_tokens", "n_taken", "most_copies", "taken_tokens"])
    sums = both.agg(F.sum("taken_tokens").alias("all_tokens"), F.sum(F.when(F.col("available_tokens") > 0, F.col("target_share"))).alias("all_share"))
    out = both.crossJoin(F.broadcast(sums))  # one row: scalars
    return out.select(
        "source",
        "target_share",
        F.when(F.col("available_tokens") > 0, F.round(F.col("target_share") / F.col("all_share"), 6)).otherwise(0.0).alias("attainable_share"),
        F.round(F.coalesce(F.col("taken_tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("actual_share"),
        "max_repeats",
        "most_copies",
        "n_docs",
        "n_taken",
        "available_tokens",
        "taken_tokens",
    )
