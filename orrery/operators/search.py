"""Retrieval: BM25 over weighted fields, exact nearest neighbours, rank fusion, query expansion and intent.

Scores tie-break by id everywhere. A query without terms gives no rows. Null fields have no terms.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions.fixed import ABBREVIATIONS, QUESTION_WORDS, SYNONYMS
from orrery.functions.text import split_words, terms
from orrery.session import cut

K1, B, LEAST_IDF, RRF_K = 1.2, 0.75, 1e-6, 60
# Weights of the fields of a symbol.
SYMBOL_FIELDS = {"name": 10.0, "qualified_name": 8.0, "signature": 5.0, "doc_comment": 3.0, "file_path": 1.0, "name_tokens": 7.0}
# Weights of the keyword and the vector list by intent.
BLEND = {"symbol": (0.8, 0.2), "semantic": (0.3, 0.7), "hybrid": (1.0, 1.0)}


def query_terms(query: str) -> list[str]:
    """Distinct terms of a query, operators and quotes left out."""
    import re

    return list(dict.fromkeys(t for t in re.split(r"[\W_]+", query.lower()) if t))


def expand(query: str, leak_or: bool = False) -> list[str]:
    """The query first, then the words of its compounds, abbreviations both ways and synonyms, each once whatever its case.

    `leak_or` adds the joining word itself as a term, as a compatible mode.
    """
    text = query.strip()
    if not text:
        return [""]
    back: dict[str, list[str]] = {}
    for short, long in ABBREVIATIONS.items():
        back.setdefault(long, []).append(short)
    more: list[str] = []
    for token in text.split():
        for w in split_words(token):
            more += [w] if len(w) > 1 and w != token.lower() else []
            more += [ABBREVIATIONS[w]] if w in ABBREVIATIONS else []
            more += back.get(w, [])
            more += [x for group in SYNONYMS if w in group for x in group if x != w]
    out = {text.lower(): text}
    for x in more:
        out.setdefault(x, x)
    terms_ = list(out.values())
    return terms_ + (["or"] if leak_or and len(terms_) > 1 and "or" not in out else [])


def intent(query: str) -> str:
    """symbol, semantic or hybrid, from the counts of signs of both."""
    q = query.strip()
    if not q:
        return "hybrid"
    spaces, words = " " in q, q.lower().split()
    symbol = 2 * ("_" in q) + 2 * ("." in q) + 2 * ("::" in q) + 2 * any(a.islower() and b.isupper() for a, b in zip(q, q[1:]))
    symbol += (not spaces and q[0].isupper() and any(c.islower() for c in q) and len(q) > 1) + (not spaces)
    n = sum(w in QUESTION_WORDS for w in words)
    semantic = spaces + 2 * (len(words) > 3) + (n >= 1) + 2 * (n >= 2)
    if (symbol >= 2 and semantic == 0) or (symbol > semantic + 1 and not (semantic >= 2 and symbol == 0)):
        return "symbol"
    if (semantic >= 2 and symbol == 0) or semantic > symbol + 1:
        return "semantic"
    return "hybrid"


def bm25(corpus: DataFrame, key: str, fields: dict[str, float], query: list[str] | str, n: int | None = None) -> DataFrame:
    """(id, score) of the rows with a term of the query, best first.

    Frequencies are weighted sums over the fields. The counts of the whole corpus (documents, their mean length, rows per
    term) are one aggregate; the scores are one expression per row, so nothing but the counts and the best rows moves.
    """
    wanted = query_terms(query) if isinstance(query, str) else list(dict.fromkeys(query))
    if not wanted:
        return corpus.select(F.col(key).alias("id"), F.lit(0.0).alias("score")).limit(0)
    rows = corpus.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), *[terms(F.col(f)).alias(f"t{i}") for i, f in enumerate(fields)])
    count = lambda i, t: F.size(F.filter(F.col(f"t{i}"), lambda x: x == F.lit(t)))
    tf = [sum((count(i, t) * F.lit(w) for i, w in enumerate(fields.values())), F.lit(0.0)) for t in wanted]
    length = sum((F.size(f"t{i}") for i in range(len(fields))), F.lit(0))
    scored = rows.select("id", length.alias("dl"), *[x.alias(f"f{k}") for k, x in enumerate(tf)])
    totals = scored.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean"), *[F.count_if(F.col(f"f{k}") > 0).alias(f"n{k}") for k in range(len(wanted))])
    score = F.lit(0.0)
    for k in range(len(wanted)):
        idf = F.greatest(F.log((F.col("n") - F.col(f"n{k}") + 0.5) / (F.col(f"n{k}") + 0.5)), F.lit(LEAST_IDF))
        f = F.col(f"f{k}")
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
    some = F.lit(False)
    for k in range(len(wanted)):
        some = some | (F.col(f"f{k}") > 0)
    out = scored.where(some).crossJoin(F.broadcast(totals)).select("id", score.alias("score"))  # one row: scalars
    return out.orderBy(F.desc("score"), "id").limit(n) if n else out


class Postings:
    """An inverted index of a corpus in a folder: built once, and a query reads the postings of its terms alone.

    `postings` are partitioned by a bucket of the term and sorted by it, so that the scan is pruned to a few row groups;
    each has the weighted frequency and the length of its document. `totals` is one row.
    """

    BUCKETS = 64

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, corpus: DataFrame, key: str, fields: dict[str, float], path: str) -> Postings:
        """Documents with a key; those without any term have no postings but count in the totals."""
        index = cls(corpus.sparkSession, path)
        rows = corpus.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), *[terms(F.col(f)).alias(f"t{i}") for i, f in enumerate(fields)])
        length = sum((F.size(f"t{i}") for i in range(len(fields))), F.lit(0))
        rows = rows.withColumn("dl", length)
        rows.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean")).withColumn("id", F.lit(None).cast(corpus.schema[key].dataType)).write.mode("overwrite").parquet(f"{index.path}/totals")  # with the type of the ids
        each = rows.select("id", "dl", F.explode(F.array_distinct(F.concat(*[F.col(f"t{i}") for i in range(len(fields))]))).alias("term"), *[f"t{i}" for i in range(len(fields))])
        tf = sum((F.size(F.filter(f"t{i}", lambda x: x == F.col("term"))) * F.lit(w) for i, w in enumerate(fields.values())), F.lit(0.0))
        bucket = F.pmod(F.xxhash64("term"), F.lit(cls.BUCKETS)).cast("int")
        laid = each.select("id", "dl", "term", tf.alias("tf")).withColumn("bucket", bucket)
        laid.repartition(F.col("bucket")).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{index.path}/postings")
        return index

    def search(self, query: str | list[str], n: int | None = None) -> DataFrame:
        """(id, score), the same as `bm25` over the corpus."""
        wanted = query_terms(query) if isinstance(query, str) else list(dict.fromkeys(query))
        totals = self.spark.read.parquet(f"{self.path}/totals")
        if not wanted:
            return totals.select("id", F.lit(0.0).alias("score")).limit(0)
        where = self.spark.range(1).select(*[F.pmod(F.xxhash64(F.lit(t)), F.lit(self.BUCKETS)).alias(f"b{k}") for k, t in enumerate(wanted)]).first()
        kind = totals.schema["id"].dataType.simpleString()
        read = self.spark.read.schema(f"id {kind}, dl int, term string, tf double, bucket int").parquet(f"{self.path}/postings").where(F.col("bucket").isin(*sorted({int(x) for x in where})) & F.col("term").isin(*wanted))
        counts = F.broadcast(read.groupBy("term").agg(F.count(F.lit(1)).alias("nt")))  # the terms of the query
        totals = F.broadcast(totals.drop("id"))  # one row
        idf = F.greatest(F.log((F.col("n") - F.col("nt") + 0.5) / (F.col("nt") + 0.5)), F.lit(LEAST_IDF))
        part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
        out = read.join(counts, "term").crossJoin(totals).groupBy("id").agg(F.sum(part).alias("score"))
        return out.orderBy(F.desc("score"), "id").limit(n) if n else out


def _blocks(df: DataFrame, key: str, vector: str, rows: int) -> DataFrame:
    """Rows of `rows` vectors: (block ids, block vectors laid end to end, width). Null and empty vectors are left out."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), rows):
                part = b.iloc[at : at + rows]
                m = np.stack(part["v"].to_numpy()).astype(np.float64)
                yield pd.DataFrame({"ids": [part["i"].tolist()], "flat": [m.ravel().tolist()], "width": [m.shape[1]]})

    return df.where(F.size(F.col(vector)) > 0).select(F.col(key).cast("long").alias("i"), F.col(vector).alias("v")).mapInPandas(pack, "ids array<long>, flat array<double>, width int")


def knn(base: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 10, block: int = 1024) -> DataFrame:
    """(query_id, id, similarity, rank): the k rows with the greatest cosine to each query, itself left out, exactly.

    Queries are a stated set, packed in blocks; each block meets each block of the base in one matrix product, and only
    the best k of each pair of blocks go on. Vectors of length 0 have the similarity 0; widths must be equal.
    """
    q = _blocks(queries, key, vector, block).select(F.col("ids").alias("q_ids"), F.col("flat").alias("q_flat"), F.col("width").alias("q_width"))
    b = _blocks(base, key, vector, block * 4)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit = lambda flat, width: (lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 0, n, 1))(np.asarray(flat).reshape(-1, width))
        for p in batches:
            for r in p.itertuples():
                s = np.round(unit(r.q_flat, r.q_width) @ unit(r.flat, r.width).T, 9)
                ids, q_ids = np.asarray(r.ids), np.asarray(r.q_ids)
                s[q_ids[:, None] == ids[None, :]] = -2
                order = np.lexsort((np.broadcast_to(ids, s.shape), -s))[:, :k]
                yield pd.DataFrame({"query_id": np.repeat(q_ids, order.shape[1]), "id": ids[order].ravel(), "similarity": np.take_along_axis(s, order, 1).ravel()})

    # blocks against blocks of a stated query set, no product of rows
    pairs = b.crossJoin(q).mapInPandas(best, "query_id long, id long, similarity double").where("similarity > -2")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def ranked(scores: DataFrame, n: int | None = None) -> DataFrame:
    """(id, rank) by score, of the n best, which one task numbers, or of all: then in ranges, each with the number of rows before it."""
    best = (F.desc("score"), F.asc("id"))
    if n:
        return scores.orderBy(*best).limit(n).select("id", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*best)).alias("rank"))
    placed = cut(scores.select("id", "score").repartitionByRange(*best).withColumn("__part", F.spark_partition_id()))
    sizes = {r["__part"]: r["count"] for r in placed.groupBy("__part").count().collect()}  # one per range
    before, total = [], 0
    for p in sorted(sizes):
        before.append((p, total))
        total += sizes[p]
    offsets = F.broadcast(placed.sparkSession.createDataFrame(before or [], "__part int, __before long"))
    own = F.row_number().over(W.partitionBy("__part").orderBy(*best))
    return placed.withColumn("__own", own).join(offsets, "__part").select("id", (F.col("__own") + F.col("__before")).cast("int").alias("rank"))


def rrf(lists: list[tuple[DataFrame, float, bool]], k: int = RRF_K) -> DataFrame:
    """(id, score): reciprocal ranks of lists (id, rank), each with a weight and whether its first ranks get a bonus.

    The bonus is 0.05 for rank 1 and 0.02 for ranks 2 and 3, whatever the weight.
    """
    out = None
    for df, weight, bonus in lists:
        extra = F.when(F.col("rank") == 1, 0.05).when(F.col("rank") <= 3, 0.02).otherwise(0.0) if bonus else F.lit(0.0)
        part = df.select("id", (F.lit(float(weight)) / (F.lit(k) + F.col("rank")) + extra).alias("s"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("id").agg(F.sum("s").alias("score"))


def hybrid(corpus: DataFrame, key: str, fields: dict[str, float], query: str, n: int = 20, vectors: DataFrame | None = None, where: Column | None = None, least: float | None = None) -> DataFrame:
    """(id, score): keyword list, vector list if given (id, score), and expansion at half the keyword weight, fused.

    Lists hold three times n; filters come after the fusion and before the cut.
    """
    word, meaning = BLEND[intent(query)]
    lists = [(ranked(bm25(corpus, key, fields, query, 3 * n), 3 * n), word, True)]
    if vectors is not None:
        lists.append((ranked(vectors, 3 * n), meaning, True))
    more = [t for x in expand(query)[1:] for t in query_terms(x)]
    if more:
        lists.append((ranked(bm25(corpus, key, fields, more, 3 * n), 3 * n), word * 0.5, False))
    fused = rrf(lists)
    if where is not None:
        fused = fused.join(corpus.where(where).select(F.col(key).alias("id")), "id", "left_semi")
    if least is not None:
        fused = fused.where(F.col("score") >= least)
    return fused.orderBy(F.desc("score"), "id").limit(n)


def search_files(hits: DataFrame, symbols: DataFrame, n: int = 20) -> DataFrame:
    """(file_path, n_matches, top_names, total): hits (id, score) per file, the names of its best five."""
    rows = hits.join(symbols.select("id", "name", "file_path"), "id")
    rank = F.row_number().over(W.partitionBy("file_path").orderBy(F.desc("score"), "id"))
    return (
        rows.withColumn("r", rank)
        .groupBy("file_path")
        .agg(F.count(F.lit(1)).alias("n_matches"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 5, F.struct("r", "name")))), lambda x: x["name"]), ",").alias("top_names"), F.sum("score").alias("total"))
        .orderBy(F.desc("total"), "file_path")
        .limit(n)
    )


def workspace_search(hits: DataFrame, repos: DataFrame, n: int = 5) -> DataFrame:
    """(repo, repo_rank, id, score): the n best of each repository, repositories by their best. `repos` has id, repo."""
    rows = hits.join(repos, "id")
    w = W.partitionBy("repo").orderBy(F.desc("score"), "id")
    top = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
    best = top.where("r = 1").select("repo", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("score"), "repo")).alias("repo_rank"))
    return top.join(best, "repo").select("repo", "repo_rank", "id", "score")


def rerank(hits: DataFrame, scorer: Callable[[Column], Column] | None = None, text: str = "text", n: int = 10) -> DataFrame:
    """The n best by a given scorer over a text column; without one, by the score they have."""
    scored = hits if scorer is None else hits.withColumn("score", scorer(F.col(text)))
    return scored.orderBy(F.desc("score"), "id").limit(n)
