"""Context for a token budget: estimates, packing, and a document of four tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions.text import signature_only, token_estimate
from orrery.operators import graph, search
from orrery.operators.reports import symbols

# Shares of the budget per tier, and factors of the budget by level of detail.
TIERS = {"core": 0.40, "near": 0.25, "extended": 0.20, "background": 0.15}
DETAIL = {"summary": 0.5, "standard": 1.0, "full": 2.0}
DEFAULT_BUDGET, MOST_BUDGET = 8000, 100_000


def budget(asked: int | None = None, detail: str = "standard") -> int:
    return int(min(asked or DEFAULT_BUDGET, MOST_BUDGET) * DETAIL[detail])


def pack(items: DataFrame, group: str, rank: str, tokens: str, limit: int) -> DataFrame:
    """The items of each group in order of rank up to the first that overflows the limit; the first is always kept.

    An item has one token at least, so no group needs more than limit + 1 items: the rank filter comes first and is
    applied before the shuffle, and the running sum only sees these.
    """
    order = W.partitionBy(group).orderBy(rank)
    few = items.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= limit + 1)
    total = F.sum(F.greatest(F.col(tokens), F.lit(1))).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    return few.withColumn("used", total).where((F.col("used") <= limit) | (F.col("__r") == 1)).drop("__r")


def truncate_fit(texts: DataFrame, key: str, text: str, limit: int) -> DataFrame:
    """(key, text, tokens): whole lines from the start, each with one token more, the first always."""
    rows = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.posexplode(F.split(F.col(text), "\n")).alias("p", "line"))
    kept = pack(rows.withColumn("tokens", token_estimate(F.col("line")) + 1), "key", "p", "tokens", limit)
    return kept.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "line"))), lambda x: x["line"]), "\n").alias("text"), F.sum("tokens").alias("tokens"))


def assemble(nodes: DataFrame, edges: DataFrame, query: str, limit: int = DEFAULT_BUDGET) -> str:
    """Markdown of four tiers: bodies of the best ten symbols, signatures of their neighbours, tests and siblings, files.

    What a tier leaves unused goes to the next. Rows that come to the driver are bounded by the limit.
    """
    bodies = nodes.groupBy("id").agg(F.first("body").alias("body"))
    s = symbols(nodes).join(bodies, "id")
    fields = {k: v for k, v in search.SYMBOL_FIELDS.items() if k in s.columns}
    core = search.hybrid(s, "id", fields, query, 10).cache()
    near = graph.bfs(edges, core.select("id"), 1).unionByName(graph.bfs(edges, core.select("id"), 1, reverse=True)).where("depth > 0").select("id").distinct().join(core, "id", "left_anti")
    tests = graph.bfs(edges, core.select("id"), 2, reverse=True).where("depth > 0").join(s.where("is_test = 1").select("id"), "id", "left_semi").select("id")
    files = s.join(core, "id", "left_semi").select("file_path").distinct()
    siblings = s.join(F.broadcast(files), "file_path", "left_semi").select("id")  # at most ten files
    extended = tests.unionByName(siblings).distinct().join(core, "id", "left_anti").join(near, "id", "left_anti")
    info = s.select("id", "type", "name", "file_path", "start_line", F.coalesce("body", "signature", "name").alias("body"))
    out, spare = [f"# Context: {query}"], 0
    for tier, ids, full in (("core", core, True), ("near", near, False), ("extended", extended, False)):
        text = F.col("body") if full else signature_only(F.col("body"))
        rows = ids.join(info, "id").withColumn("text", text).withColumn("tokens", token_estimate(F.col("text")))
        rank = F.struct(-F.col("score"), "id") if full else F.struct("file_path", "start_line", "id")
        room = int(limit * TIERS[tier]) + spare
        kept = pack(rows.withColumn("rank", rank).withColumn("g", F.lit(1)), "g", "rank", "tokens", room).orderBy("rank").collect()
        spare = max(0, room - (kept[-1]["used"] if kept else 0))
        out.append(f"\n## {tier.title()}")
        for r in kept:
            out.append(f"\n### {r['type']} {r['name']} ({r['file_path']}:{r['start_line']})\n```\n{r['text']}\n```" if full else f"- {r['type']} `{r['name']}` {r['file_path']}:{r['start_line']} — {r['text']}")
    room = int(limit * TIERS["background"]) + spare
    listed = s.groupBy("file_path").agg(F.count(F.lit(1)).alias("n")).withColumn("tokens", token_estimate(F.col("file_path"))).withColumn("g", F.lit(1))
    rows = pack(listed.withColumn("rank", F.struct(-F.col("n"), "file_path")), "g", "rank", "tokens", room).orderBy("rank").collect()
    out.append("\n## Background")
    out += [f"- {r['file_path']} ({r['n']} symbols)" for r in rows]
    core.unpersist()
    return "\n".join(out)


def token_benchmark(nodes: DataFrame, edges: DataFrame, query: str, limit: int = DEFAULT_BUDGET) -> dict:
    """Tokens of all bodies against those of the context."""
    all_ = nodes.groupBy("id").agg(F.first("body").alias("body")).agg(F.sum(token_estimate(F.col("body"))).alias("n")).first()["n"] or 0
    text = assemble(nodes, edges, query, limit)
    one = nodes.sparkSession.createDataFrame([(text,)], "t string").select(token_estimate(F.col("t")).alias("n")).first()["n"]
    return {"baseline": all_, "context": one, "reduction": 1 - one / all_ if all_ else 0.0}
