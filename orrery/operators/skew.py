"""A few keys holding most records (problem 4): fragment-replicate by estimated load.

Keys are bin-packed to tasks by their load, large keys are split into shards in proportion to it, and the other side of
a join is replicated only to the shards of the large keys. Nothing is dropped, capped or sampled.

Defined results: a null in a key column is a key of its own in aggregates (as in SQL) and matches nothing in joins; a
null source counts as a row but not as a distinct source; repeated rows count as they are; empty tables give no rows.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.session import written


@dataclass
class ShardPlan:
    """tasks: number of partitions. load: rows per key. heavy: the keys that are split, fewer than `tasks` rows, with
    `shards` and the tasks of their shards. buckets: the task of each hash bucket of the other keys."""

    tasks: int
    total: int
    heavy: DataFrame
    buckets: list[int]


def estimate_load(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per key; combined before the shuffle."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("load"))


def plan_shards(load: DataFrame, keys: list[str], tasks: int, buckets_per_task: int = 16) -> ShardPlan:
    """Split every key with more than one task's share; pack the rest, by hash bucket, into the emptiest tasks.

    What comes to the driver is bounded by the number of tasks: fewer than `tasks` keys can exceed total / tasks, and
    there are tasks * buckets_per_task buckets.
    """
    spark = load.sparkSession
    n = tasks * buckets_per_task
    bucket = F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")
    total = load.agg(F.coalesce(F.sum("load"), F.lit(0))).first()[0]
    share = max(1, -(-total // tasks))
    big = load.where(F.col("load") > share).collect()
    small = load.where(F.col("load") <= share).groupBy(bucket.alias("b")).agg(F.sum("load").alias("load")).collect()
    free = [(0, t) for t in range(tasks)]
    heapq.heapify(free)

    def place(size: int) -> int:
        used, t = heapq.heappop(free)
        heapq.heappush(free, (used + size, t))
        return t

    rows = []
    for r in sorted(big, key=lambda r: (-r["load"], *map(str, (r[k] for k in keys)))):
        k = min(tasks, -(-r["load"] // share))
        rows.append((*(r[c] for c in keys), k, [place(-(-r["load"] // k)) for _ in range(k)]))
    at = [0] * n
    for b, size in sorted(((r["b"], r["load"]) for r in small), key=lambda x: (-x[1], x[0])):
        at[b] = place(size)
    fields = [load.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField("shards", T.IntegerType()), T.StructField("shard_tasks", T.ArrayType(T.IntegerType()))])
    return ShardPlan(tasks, total, spark.createDataFrame(rows, schema), at)


def _same(left: str, keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"l.{k}").eqNullSafe(F.col(f"h.{k}"))
    return cond


def assign_tasks(df: DataFrame, keys: list[str], plan: ShardPlan, by: Column) -> DataFrame:
    """Adds __shard (0 for keys that are not split) and __task. `by` spreads the rows of a split key over its shards."""
    n = len(plan.buckets)
    light = F.element_at(F.array(*map(F.lit, plan.buckets)), F.pmod(F.xxhash64(*[F.col(f"l.{k}") for k in keys]), F.lit(n)).cast("int") + 1)
    joined = df.withColumn("__by", by).alias("l").join(F.broadcast(plan.heavy.alias("h")), _same("l", keys), "left")
    shard = F.coalesce(F.pmod(F.xxhash64("__by"), F.col("h.shards")), F.lit(0)).cast("int")
    return joined.select("l.*", shard.alias("__shard"), F.col("h.shard_tasks").alias("__at"), light.alias("__light")).select(
        *df.columns, "__shard", F.coalesce(F.element_at("__at", F.col("__shard") + 1), F.col("__light")).alias("__task")
    )


def tasks_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def count_and_distinct(df: DataFrame, keys: list[str], source: str, tasks: int | None = None) -> DataFrame:
    """Per key: `rows` and `distinct_sources`.

    Rows are first combined to (key, source, count). These pairs, not the rows, are the load of the second step: a key
    with many sources is split by source over shards, so the distinct counts of its shards add up exactly.
    """
    tasks = tasks or tasks_of(df)
    pairs = df.groupBy(*keys, source).agg(F.count(F.lit(1)).alias("__n"))
    pairs = written(pairs)  # read twice: for the load and for the result
    plan = plan_shards(estimate_load(pairs, keys), keys, tasks)
    placed = assign_tasks(pairs, keys, plan, F.col(source)).repartitionById(tasks, F.col("__task"))
    # each task holds whole shards: the partial sums leave it as one row per key and shard
    return placed.groupBy(*keys).agg(F.sum("__n").alias("rows"), F.count(source).alias("distinct_sources"))


def plan_salts(load: DataFrame, keys: list[str], tasks: int, part: int = 4) -> DataFrame:
    """(keys, salts): the keys that don't stay where hash partitioning over (keys, 0) puts them, with a salt for each shard.

    A key with more than 1 / `part` of a task's share is placed by hand: split into shards of at most that part, in
    proportion to its load, and each shard put into the task that is emptiest by then, beginning with what hash
    partitioning gives it of the other keys; shards of a key in one task are one. A salt is the least number with which hash partitioning over (keys, salt) sends
    the key to that task, so the layout of the join is the one that Spark makes anyway. There are fewer than `part` *
    `tasks` such keys, and the driver holds no more than these and one load per task.
    """
    spark = load.sparkSession
    total = load.agg(F.coalesce(F.sum("load"), F.lit(0))).first()[0]
    share = max(1, -(-total // tasks))
    least = max(1, share // part)
    home = F.pmod(F.hash(*keys, F.lit(0)), F.lit(tasks))
    big = load.where(F.col("load") > least).collect()
    rest = {r.t: r.load for r in load.where(F.col("load") <= least).groupBy(home.alias("t")).agg(F.sum("load").alias("load")).collect()}
    free = [(rest.get(t, 0), t) for t in range(tasks)]
    heapq.heapify(free)
    rows = []
    for r in sorted(big, key=lambda r: (-r["load"], *map(str, (r[k] for k in keys)))):
        n = -(-r["load"] // least)
        at = []
        for _ in range(n):
            used, t = heapq.heappop(free)
            heapq.heappush(free, (used + -(-r["load"] // n), t))
            at.append(t)
        rows.append((*(r[c] for c in keys), at))
    schema = T.StructType([*[load.schema[k] for k in keys], T.StructField("__at", T.ArrayType(T.IntegerType()))])
    placed = spark.createDataFrame(rows, schema).select(*keys, F.posexplode("__at").alias("__no", "__task"))
    # of 24 * tasks salts some fits each task but for one case in e^24; then the shard takes salt 0, which is only slower
    salt = F.filter(F.sequence(F.lit(0), F.lit(24 * tasks)), lambda x: F.pmod(F.hash(*keys, x), F.lit(tasks)) == F.col("__task"))
    found = placed.select(*keys, "__no", F.coalesce(F.try_element_at(salt, F.lit(1)), F.lit(0)).alias("__salt"))
    return found.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("__no", "__salt"))), lambda x: x["__salt"]).alias("salts"))


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", tasks: int | None = None) -> DataFrame:
    """Join a skewed left side by fragment and replicate: keys are packed into tasks by load, large ones are spread over
    shards, and only their right rows are copied, once to each shard.

    A first pass over the keys of the left side gives the loads, combined before the shuffle; each side is then shuffled
    once. A row's shard comes from a hash of the whole row, so that it's the same if a lost task runs again. Rows with a
    null key meet nothing; they are spread by that hash.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"the right side is replicated, so {how!r} isn't possible")
    tasks = tasks or tasks_of(left)
    salts = F.broadcast(plan_salts(estimate_load(left.where(_none_null(keys)), keys), keys, tasks).alias("h"))  # fewer than 4 * tasks rows
    whole = F.pmod(F.xxhash64(*[F.col(f"l.{c}") for c in left.columns]), F.lit(1 << 30)).cast("int")
    none = F.lit(False)
    for k in keys:
        none = none | F.col(f"l.{k}").isNull()
    own = F.when(none, whole).when(F.col("h.salts").isNull(), 0).otherwise(F.element_at("h.salts", F.pmod(whole, F.size("h.salts")).cast("int") + 1))
    placed = left.alias("l").join(salts, _same("l", keys), "left").select("l.*", own.alias("__salt"))
    each = F.explode(F.array_distinct(F.coalesce(F.col("h.salts"), F.array(F.lit(0)))))
    copied = right.alias("l").join(salts, _same("l", keys), "left").select("l.*", each.alias("__salt"))
    on = [*keys, "__salt"]
    return placed.repartition(tasks, *on).join(copied.repartition(tasks, *on), on, how).drop("__salt")


def _none_null(keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return cond


def in_degrees(edges: DataFrame) -> DataFrame:
    """Per (target_id, type): in_degree (all rows) and distinct_sources."""
    return count_and_distinct(edges.select("target_id", "type", "source_id"), ["target_id", "type"], "source_id").select(
        "target_id", "type", F.col("rows").alias("in_degree"), "distinct_sources"
    )


def heavy_keys(edges: DataFrame, share: float = 0.01) -> DataFrame:
    """Keys of the skewed aggregate that hold at least `share` of all rows."""
    degrees = in_degrees(edges)
    total = degrees.agg(F.sum("in_degree").alias("__total"))
    return degrees.crossJoin(F.broadcast(total)).where(F.col("in_degree") >= F.col("__total") * share).drop("__total")  # one row: a scalar
