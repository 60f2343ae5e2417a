"""Graph analytics on (source_id, target_id, type) edges: reachability, paths, impact, components, ranks.

Every step is a join of a frontier with the edges; visited vertices are left out by an anti-join, and each superstep is
written to the checkpoint folder. Only ids travel; attributes are joined last. A negative or zero depth gives no
vertices beyond the seeds. Null ends are no edges. Repeated edges count once, except in the ranks, which count them.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.session import cut


def links(edges: DataFrame, types: list[str] | None = None, reverse: bool = False) -> DataFrame:
    """Distinct (src, dst), of the given types, turned round if asked."""
    e = edges.where(F.col("source_id").isNotNull() & F.col("target_id").isNotNull())
    if types is not None:
        e = e.where(F.col("type").isin(*types))
    a, b = ("target_id", "source_id") if reverse else ("source_id", "target_id")
    return e.select(F.col(a).alias("src"), F.col(b).alias("dst")).distinct()


def vertices(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, vertex_type): nodes, and ends of edges that are no nodes."""
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).where("id is not null").distinct()
    ids = nodes.select("id").distinct()
    kind = F.when(F.col("id").startswith("file:"), "file").when(F.col("id").startswith("module:"), "module").when(F.col("id").startswith("unresolved:"), "unresolved").otherwise("dangling")
    return ids.withColumn("vertex_type", F.lit("symbol")).unionByName(ends.join(ids, "id", "left_anti").withColumn("vertex_type", kind))


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int, types: list[str] | None = None, reverse: bool = False) -> DataFrame:
    """(id, depth): the least number of steps from any seed; seeds have depth 0."""
    found = frontier = cut(seeds.select("id").where("id is not null").distinct().withColumn("depth", F.lit(0)))
    adjacency = links(edges, types, reverse)
    if max_depth > 1:
        adjacency = cut(adjacency)  # laid out once, not on every level
    for depth in range(1, max_depth + 1):
        step = adjacency.join(frontier.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        frontier = cut(step.join(found.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)  # of checkpointed parts
        if depth % 10 == 0:
            found = cut(found)
    return found


def all_depths(edges: DataFrame, seeds: DataFrame, max_depth: int, types: list[str] | None = None, reverse: bool = False, substring_check: bool = False) -> DataFrame:
    """Distinct (id, depth) over simple paths: a vertex may come at several depths.

    `substring_check` stops a path at ids that are part of its text, as a compatible mode; else membership decides.
    """
    adjacency = links(edges, types, reverse)
    paths = seeds.select(F.col("id").alias("at")).distinct().withColumn("path", F.array("at"))
    out = None
    for depth in range(1, max_depth + 1):
        met = F.instr(F.array_join("path", ","), F.col("dst")) > 0 if substring_check else F.array_contains("path", F.col("dst"))
        step = paths.join(adjacency, F.col("at") == F.col("src")).where(~met)
        paths = cut(step.select(F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path")))
        level = paths.select(F.col("at").alias("id")).distinct().withColumn("depth", F.lit(depth))
        out = level if out is None else out.unionByName(level)
        if paths.isEmpty():
            break
    return out if out is not None else seeds.select("id").withColumn("depth", F.lit(0)).limit(0)


def dependencies(edges: DataFrame, seeds: DataFrame, max_depth: int = 5) -> DataFrame:
    return bfs(edges, seeds, min(max_depth, 50)).where("depth > 0")


def callees(edges: DataFrame, seeds: DataFrame, max_depth: int = 5) -> DataFrame:
    return bfs(edges, seeds, min(max_depth, 50), ["calls"]).where("depth > 0")


def callers(edges: DataFrame, seeds: DataFrame, max_depth: int = 5) -> DataFrame:
    return bfs(edges, seeds, min(max_depth, 50), ["calls"], reverse=True).where("depth > 0")


def transitive_dependencies(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    return dependencies(edges, seeds, 50)


def neighborhood(edges: DataFrame, seeds: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """(vertices within radius by out-edges only or by in-edges only, the edges among them)."""
    ids = bfs(edges, seeds, radius).select("id").unionByName(bfs(edges, seeds, radius, reverse=True).select("id")).distinct()
    inner = edges.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    return ids, inner.select("source_id", "target_id", "type").distinct()


def find_path(edges: DataFrame, start: DataFrame, goal: DataFrame, max_depth: int = 10, types: list[str] | None = None) -> DataFrame:
    """(path): one shortest path, the least of them; a start that is the goal gives itself; none gives no row."""
    adjacency = links(edges, types)
    goals = goal.select("id").distinct()
    level = cut(start.select("id").distinct().withColumn("path", F.array("id")))
    seen = level.select("id")
    for depth in range(max_depth + 1):
        hit = level.join(goals, "id", "left_semi")
        if not hit.isEmpty():
            return hit.agg(F.min("path").alias("path"))
        if depth == max_depth:
            break
        step = level.join(adjacency, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        level = cut(step.join(seen, "id", "left_anti").groupBy("id").agg(F.min("path").alias("path")))
        if level.isEmpty():
            break
        seen = cut(seen.unionByName(level.select("id")))
    return start.sparkSession.createDataFrame([], "path array<string>")


def risk(n) -> F.Column:
    return F.when(n > 50, "critical").when(n > 20, "high").when(n > 5, "medium").otherwise("low")


def impact(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, max_depth: int = 20) -> DataFrame:
    """One row: direct_dependents, transitive_dependents (nodes only), n_files, affected_files, risk."""
    ids = nodes.select("id", "file_path").dropDuplicates(["id"])
    reached = bfs(edges, seeds, max_depth, reverse=True).where("depth > 0").join(ids, "id")
    return reached.agg(
        F.count_if(F.col("depth") == 1).alias("direct_dependents"),
        F.count(F.lit(1)).alias("transitive_dependents"),
        F.countDistinct("file_path").alias("n_files"),
        F.array_join(F.array_sort(F.collect_set("file_path")), ",").alias("affected_files"),
    ).withColumn("risk", risk(F.col("transitive_dependents")))


def impact_buckets(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, max_depth: int = 10) -> DataFrame:
    """(id, depth, impact): callers by least depth; 1 is high, 3 medium, else low."""
    near = bfs(edges, seeds, max_depth, ["calls"], reverse=True).where("depth > 0").join(nodes.select("id").distinct(), "id", "left_semi")
    return near.withColumn("impact", F.when(F.col("depth") <= 1, "high").when(F.col("depth") <= 3, "medium").otherwise("low"))


#: Names of seeds that are held against all tests at once.
NAME_BLOCK = 10_000


def tests_for(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, max_depth: int = 5) -> DataFrame:
    """(file_path, test_ids): tests that reach the seeds; where none does, those whose name or path tells."""
    tests = nodes.where("is_test = 1").select("id", "file_path", "name").dropDuplicates(["id"])
    by_graph = bfs(edges, seeds, max_depth, reverse=True).where("depth > 0").join(tests, "id")
    if not by_graph.isEmpty():
        hits = by_graph
    else:
        names = cut(nodes.join(seeds.select("id"), "id", "left_semi").select(F.lower("name").alias("seed")).distinct())
        blocks = -(-max(1, names.count()) // NAME_BLOCK)
        hits = None  # a stated set of seeds against all tests, in blocks of a bounded size
        for k in range(blocks):
            some = F.broadcast(names.where(F.pmod(F.xxhash64("seed"), F.lit(blocks)) == k))
            part = tests.join(some, F.lower("name").contains(F.col("seed"))).select("id", "file_path")
            hits = part if hits is None else hits.unionByName(part)
    return hits.groupBy("file_path").agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias("test_ids"))


def pagerank(edges: DataFrame, nodes: DataFrame, iterations: int = 100, damping: float = 0.85, personal: DataFrame | None = None) -> DataFrame:
    """(id, rank). Parallel edges count each; edges that leave the nodes don't; dangling mass goes to the teleport set.

    Adjacency is laid out once by source and kept in the checkpoint folder; a superstep is one join and one sum.
    """
    ids = nodes.select("id").distinct()
    e = edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")).join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    weighted = e.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    degree = weighted.groupBy("src").agg(F.sum("n").alias("degree"))
    adjacency = cut(weighted.join(degree, "src").select("src", "dst", (F.col("n") / F.col("degree")).alias("part")).repartition("src"))
    home = ids if personal is None else ids.join(personal.select("id").distinct(), "id", "left_semi")
    n = home.count()
    if n == 0:
        return ids.limit(0).withColumn("rank", F.lit(0.0))
    teleport = ids.join(home.withColumn("home", F.lit(1.0 / n)), "id", "left").na.fill(0.0, ["home"])
    state = cut(teleport.join(degree.select(F.col("src").alias("id"), "degree"), "id", "left").select("id", "home", F.col("degree").isNull().alias("dangling"), F.col("home").alias("rank")).repartition("id"))
    for i in range(iterations):
        lost = state.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)).alias("lost"))
        given = state.select(F.col("id").alias("src"), "rank").join(adjacency, "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("part")).alias("got"))
        state = state.join(given, "id", "left").crossJoin(F.broadcast(lost)).select(  # one row: a scalar
            "id", "home", "dangling", ((1 - damping) * F.col("home") + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") * F.col("home"))).alias("rank")
        )
        if i % 3 == 2 or i == iterations - 1:
            state = cut(state)
    out = state.select("id", "rank")
    return out if personal is None else out.where("rank > 1e-10")


def _rounds(most: int | None) -> Iterator[int]:
    """Numbers of rounds without end; an error where `most` rounds gave no fixpoint."""
    for n in itertools.count():
        if n == most:
            raise RuntimeError(f"no fixpoint after {most} rounds")
        yield n


def components(edges: DataFrame, types: list[str] | None = None, max_rounds: int | None = None) -> DataFrame:
    """(id, component) of the strongly connected components of two vertices or more; component is their least id.

    Vertices without an edge in or out are trimmed; the least id that reaches a vertex colours it; what reaches the root
    of its colour, inside the colour, is a component. The rest goes on without it. All loops run to the fixpoint, which each
    reaches; with `max_rounds` there's an error where one needs more.
    """
    left = cut(links(edges, types).where("src <> dst"))
    found = None
    for _ in _rounds(max_rounds):
        left, rest = _trim(left, max_rounds)
        if rest == 0:
            break
        colour = cut(left.select(F.col("src").alias("id")).distinct().withColumn("colour", F.col("id")))
        for _ in _rounds(max_rounds):
            offered = left.join(colour.select(F.col("id").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("offer"))
            new = cut(colour.join(offered, "id", "left").select("id", F.least("colour", F.coalesce("offer", "colour")).alias("colour"), (F.col("offer") < F.col("colour")).alias("changed")))
            stop = new.where("changed").isEmpty()
            colour = new.select("id", "colour")
            if stop:
                break
        inside = cut(
            left.join(colour.select(F.col("id").alias("src"), F.col("colour").alias("a")), "src").join(colour.select(F.col("id").alias("dst"), F.col("colour").alias("b")), "dst").where("a = b").select("src", "dst", F.col("a").alias("colour"))
        )
        member = cut(colour.where("id = colour"))
        frontier = member
        for _ in _rounds(max_rounds):
            step = inside.join(frontier.select(F.col("id").alias("dst"), "colour"), ["dst", "colour"], "left_semi").select(F.col("src").alias("id"), "colour").distinct()
            frontier = cut(step.join(member.select("id"), "id", "left_anti"))
            if frontier.isEmpty():
                break
            member = cut(member.unionByName(frontier))
        several = member.groupBy("colour").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("colour")
        part = member.join(several, "colour", "left_semi").select("id", F.col("colour").alias("component"))
        found = cut(part if found is None else found.unionByName(part))
        gone = member.select("id")
        left = cut(left.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti"))
    if found is None:
        return edges.select(F.col("source_id").alias("id"), F.col("source_id").alias("component")).limit(0)
    return found.join(found.groupBy("component").agg(F.min("id").alias("least")), "component").select("id", F.col("least").alias("component"))


def _trim(left: DataFrame, max_rounds: int | None) -> tuple[DataFrame, int]:
    """Edges between vertices that have both an edge in and an edge out, to the fixpoint; their number."""
    n = left.count()
    for _ in _rounds(max_rounds):
        if n == 0:
            break
        heads, tails = left.select(F.col("dst").alias("src")).distinct(), left.select(F.col("src").alias("dst")).distinct()
        left = cut(left.join(heads, "src", "left_semi").join(tails, "dst", "left_semi"))
        now = left.count()
        if now == n:
            break
        n = now
    return left, n


def cycles(edges: DataFrame, types: list[str] | None = None) -> DataFrame:
    """(component, size) of the cycles: components of two vertices or more."""
    return components(edges, types).groupBy("component").agg(F.count(F.lit(1)).alias("size"))
