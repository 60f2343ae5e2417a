"""Quality measures of retrieval: precision, recall, F1 and reciprocal rank, as array expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prf(found: DataFrame, expected: DataFrame, key: str, item: str) -> DataFrame:
    """(key, precision, recall, f1) of the sets of items per key; an empty side gives 0."""
    f = found.select(key, item).distinct().withColumn("f", F.lit(1))
    e = expected.select(key, item).distinct().withColumn("e", F.lit(1))
    n = f.join(e, [key, item], "full").groupBy(key).agg(F.sum(F.coalesce("f", F.lit(0)) * F.coalesce("e", F.lit(0))).alias("hit"), F.count("f").alias("nf"), F.count("e").alias("ne"))
    p = F.when(F.col("nf") > 0, F.col("hit") / F.col("nf")).otherwise(0.0)
    r = F.when(F.col("ne") > 0, F.col("hit") / F.col("ne")).otherwise(0.0)
    return n.select(key, p.alias("precision"), r.alias("recall")).withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def reciprocal_rank(ranked: DataFrame, expected: DataFrame, key: str, item: str, rank: str = "rank") -> DataFrame:
    """(key, rr): one over the rank of the first expected item, 0 if there is none."""
    hit = ranked.join(expected.select(key, item).distinct(), [key, item], "left_semi").groupBy(key).agg((1.0 / F.min(rank)).alias("rr"))
    return expected.select(key).distinct().join(hit, key, "left").select(key, F.coalesce("rr", F.lit(0.0)).alias("rr"))


def macro(measures: DataFrame) -> DataFrame:
    """One row: means over the keys."""
    return measures.agg(*[F.avg(c).alias(c) for c in measures.columns[1:]])


def eval_search(hits: DataFrame, expected: DataFrame, n: int = 10) -> DataFrame:
    """(query, precision, recall, f1): names of the n best hits (query, name, rank) against the expected (query, name)."""
    return prf(hits.where(F.col("rank") <= n), expected, "query", "name")


def found_callers(nodes: DataFrame, edges: DataFrame, callees: DataFrame) -> DataFrame:
    """(callee, caller): names of the nodes that call a node of the callee's name."""
    named = nodes.select("id", "name").distinct()
    calls = edges.where("type = 'calls'").select("source_id", "target_id").distinct()
    into = named.join(F.broadcast(callees.select(F.col("callee").alias("name")).distinct()), "name").select(F.col("id").alias("target_id"), F.col("name").alias("callee"))  # a stated set
    return calls.join(into, "target_id").join(named.select(F.col("id").alias("source_id"), F.col("name").alias("caller")), "source_id").select("callee", "caller").distinct()


def eval_callers(nodes: DataFrame, edges: DataFrame, expected: DataFrame) -> DataFrame:
    """(callee, precision, recall, f1) against the expected (callee, caller)."""
    return prf(found_callers(nodes, edges, expected), expected, "callee", "caller")


def found_dead(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name): symbols without an edge into them that are no modules and stand in no index file."""
    rows = nodes.where(~F.col("type").isin("module", "namespace") & ~F.col("file_path").ilike("%index.ts"))
    return rows.join(edges.select(F.col("target_id").alias("id")).distinct(), "id", "left_anti").select("name").distinct()


def eval_dead(nodes: DataFrame, edges: DataFrame, expected: DataFrame) -> DataFrame:
    """One row (key 'dead'): the dead names against the expected (name)."""
    one = F.lit("dead").alias("key")
    return prf(found_dead(nodes, edges).select(one, "name"), expected.select(one, "name"), "key", "name")


def found_dependencies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, dependency): other files with a symbol that a symbol of the file imports."""
    where = nodes.select("id", "file_path").distinct()
    e = edges.where("type = 'imports'").select("source_id", "target_id").distinct()
    both = e.join(where.select(F.col("id").alias("source_id"), F.col("file_path").alias("file")), "source_id").join(where.select(F.col("id").alias("target_id"), F.col("file_path").alias("dependency")), "target_id")
    return both.where("file <> dependency").select("file", "dependency").distinct()


def eval_dependencies(nodes: DataFrame, edges: DataFrame, expected: DataFrame) -> DataFrame:
    """(file, precision, recall, f1) of the files in the expected (file, dependency)."""
    asked = found_dependencies(nodes, edges).join(expected.select("file").distinct(), "file", "left_semi")
    return prf(asked, expected, "file", "dependency")


def run_evaluation(nodes: DataFrame, edges: DataFrame, hits: DataFrame, truth: dict[str, DataFrame], least_nodes: int = 0, least_edges: int = 0) -> DataFrame:
    """(part, precision, recall, f1, enough): search, callers, dead, dependencies and their mean, as macro averages.

    `truth` has the expected tables of the four parts; `enough` tells whether there are as many nodes and edges as expected.
    """
    parts = {
        "search": eval_search(hits, truth["search"]),
        "callers": eval_callers(nodes, edges, truth["callers"]),
        "dead": eval_dead(nodes, edges, truth["dead"]),
        "dependencies": eval_dependencies(nodes, edges, truth["dependencies"]),
    }
    out = None
    for name, rows in parts.items():
        one = macro(rows).select(F.lit(name).alias("part"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")])
        out = one if out is None else out.unionByName(one)
    whole = out.agg(F.lit("overall").alias("part"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])
    enough = nodes.select("id").distinct().count() >= least_nodes and edges.count() >= least_edges
    return out.unionByName(whole).withColumn("enough", F.lit(enough))
