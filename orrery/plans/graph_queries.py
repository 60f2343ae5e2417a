"""Queries of the graph operators, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.operators import graph, reports
from orrery.sources.tables import table


def part_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Consecutive parts of an order, as edges with text ids."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    pairs = lines.select(F.col("l_partkey").alias("a"), F.lead("l_partkey").over(order).alias("b")).where("b is not null and a <> b").distinct()
    return pairs.select(F.col("a").cast("string").alias("source_id"), F.col("b").cast("string").alias("target_id"), F.lit("next").alias("type"))


def seed(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id string")


def first_symbol(spark: SparkSession, folder: str) -> DataFrame:
    """The node with most edges from other nodes, the least of them: the seed of the code-graph queries."""
    nodes = table(spark, folder, "nodes").select("id").distinct()
    e = table(spark, folder, "edges").where("type = 'calls'").select("source_id", "target_id").distinct()
    top = e.join(nodes.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(nodes.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    return top.groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "id").limit(1).select("id")


def bfs_min_depth(spark, folder):
    return graph.bfs(part_graph(spark, folder), seed(spark, "1"), 3)


def reverse_bfs(spark, folder):
    return graph.bfs(part_graph(spark, folder), seed(spark, "1"), 2, reverse=True)


def all_depths(spark, folder):
    return graph.all_depths(fk_graph(spark, folder), seed(spark, "order:1", "order:2", "order:3"), 4)


def fk_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Keys as typed edges: order to customer to nation to region, supplier to nation, order to part."""
    t = lambda n: table(spark, folder, n)
    edge = lambda df, a, x, b, y, kind: df.select(F.concat(F.lit(a + ":"), F.col(x)).alias("source_id"), F.concat(F.lit(b + ":"), F.col(y)).alias("target_id"), F.lit(kind).alias("type"))
    parts = [
        edge(t("orders"), "order", "o_orderkey", "customer", "o_custkey", "placed_by"),
        edge(t("customer"), "customer", "c_custkey", "nation", "c_nationkey", "lives_in"),
        edge(t("supplier"), "supplier", "s_suppkey", "nation", "s_nationkey", "lives_in"),
        edge(t("nation"), "nation", "n_nationkey", "region", "n_regionkey", "part_of"),
        edge(t("lineitem"), "order", "l_orderkey", "part", "l_partkey", "contains"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def neighborhood_nodes(spark, folder):
    return graph.neighborhood(part_graph(spark, folder), seed(spark, "1"), 1)[0]


def neighborhood_edges(spark, folder):
    return graph.neighborhood(part_graph(spark, folder), seed(spark, "1"), 1)[1]


def find_path_len(spark, folder):
    return graph.find_path(part_graph(spark, folder), seed(spark, "1"), seed(spark, "100"), 10).select((F.size("path") - 1).alias("hops"), F.element_at("path", 1).alias("first"), F.element_at("path", -1).alias("last"))


def callers(spark, folder):
    return graph.callers(table(spark, folder, "edges"), first_symbol(spark, folder), 5)


def callees(spark, folder):
    return graph.callees(table(spark, folder, "edges"), first_symbol(spark, folder), 5)


def dependencies(spark, folder):
    return graph.dependencies(table(spark, folder, "edges"), first_symbol(spark, folder), 3)


def transitive_deps(spark, folder):
    return graph.transitive_dependencies(table(spark, folder, "edges"), first_symbol(spark, folder)).select("id")


def impact_risk(spark, folder):
    return graph.impact(table(spark, folder, "edges"), table(spark, folder, "nodes"), first_symbol(spark, folder), 4)


def impact_buckets(spark, folder):
    return graph.impact_buckets(table(spark, folder, "edges"), table(spark, folder, "nodes"), first_symbol(spark, folder), 10)


def tests_for(spark, folder):
    return graph.tests_for(table(spark, folder, "edges"), table(spark, folder, "nodes"), first_symbol(spark, folder), 5)


def pagerank_20(spark, folder):
    return graph.pagerank(table(spark, folder, "edges"), table(spark, folder, "nodes"), 20).select("id", F.round("rank", 9).alias("rank"))


def ppr_20(spark, folder):
    return graph.pagerank(table(spark, folder, "edges"), table(spark, folder, "nodes"), 20, personal=first_symbol(spark, folder)).select("id", F.round("rank", 9).alias("rank"))


def diagram(spark, folder):
    """The neighborhood of the first symbol as a diagram, a row per line."""
    edges, nodes = table(spark, folder, "edges"), table(spark, folder, "nodes")
    text = reports.mermaid(graph.neighborhood(edges, first_symbol(spark, folder), 1)[1], nodes.select("id", "name"))
    return spark.createDataFrame(list(enumerate(text.split("\n"), 1)), "line_no int, line string")


def cycles(spark, folder):
    return graph.cycles(table(spark, folder, "edges"))


def vertex_types(spark, folder):
    return graph.vertices(table(spark, folder, "nodes"), table(spark, folder, "edges")).groupBy("vertex_type").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (bfs_min_depth, reverse_bfs, all_depths, neighborhood_nodes, neighborhood_edges, find_path_len, callers, callees, dependencies, transitive_deps, impact_risk, impact_buckets, tests_for, pagerank_20, ppr_20, diagram, cycles, vertex_types)}

_PART = """
lines AS (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b FROM lineitem),
part_graph AS (SELECT DISTINCT CAST(a AS VARCHAR) AS src, CAST(b AS VARCHAR) AS dst FROM lines WHERE b IS NOT NULL AND a <> b)"""
_FK = """
fk AS (SELECT DISTINCT * FROM (
  SELECT 'order:' || o_orderkey AS src, 'customer:' || o_custkey AS dst FROM orders UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation
  UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey FROM lineitem))"""
_LINKS = "ids AS (SELECT DISTINCT id FROM nodes), link AS (SELECT DISTINCT source_id AS src, target_id AS dst, type FROM edges WHERE source_id IS NOT NULL AND target_id IS NOT NULL)"
_SEED = """
seed AS (SELECT dst AS id FROM (SELECT DISTINCT src, dst FROM link WHERE type = 'calls') WHERE src IN (SELECT id FROM ids) AND dst IN (SELECT id FROM ids) GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1)"""


_ONE = "SELECT '1' AS id"


def _walk(pairs: str, seeds: str, depth: int, a: str = "src", b: str = "dst") -> str:
    return f"w AS (SELECT id, 0 AS depth FROM ({seeds}) UNION SELECT l.{b}, w.depth + 1 FROM w JOIN ({pairs}) l ON l.{a} = w.id WHERE w.depth < {depth}), reached AS (SELECT id, CAST(min(depth) AS INT) AS depth FROM w GROUP BY 1)"


def _code(depth: int, types: str, reverse: bool) -> str:
    pairs = "SELECT DISTINCT src, dst FROM link" + (f" WHERE type = '{types}'" if types else "")
    a, b = ("dst", "src") if reverse else ("src", "dst")
    return f"WITH RECURSIVE {_LINKS}, {_SEED}, {_walk(pairs, 'SELECT id FROM seed', depth, a, b)}"


def _ranks(iterations: int, home: str) -> str:
    out = f"""WITH {_LINKS}, {_SEED},
e AS (SELECT source_id AS src, target_id AS dst FROM edges WHERE source_id IN (SELECT id FROM ids) AND target_id IN (SELECT id FROM ids)),
deg AS (SELECT src, count(*) AS d FROM e GROUP BY 1),
adj AS MATERIALIZED (SELECT e.src, e.dst, 1.0 / deg.d AS part FROM e JOIN deg USING (src)),
home AS MATERIALIZED ({home}),
p0 AS MATERIALIZED (SELECT h.id, h.home, deg.d IS NULL AS dangling, h.home AS rank FROM home h LEFT JOIN deg ON deg.src = h.id)"""
    for i in range(iterations):
        out += f""",
p{i + 1} AS MATERIALIZED (SELECT p.id, p.home, p.dangling, 0.15 * p.home + 0.85 * (coalesce(g.got, 0) + (SELECT coalesce(sum(rank), 0) FROM p{i} WHERE dangling) * p.home) AS rank
  FROM p{i} p LEFT JOIN (SELECT a.dst AS id, sum(q.rank * a.part) AS got FROM p{i} q JOIN adj a ON a.src = q.id GROUP BY 1) g ON g.id = p.id)"""
    return out + f" SELECT id, round(rank, 9) AS rank FROM p{iterations}"


ORACLES = {
    "bfs_min_depth": f"WITH RECURSIVE {_PART}, {_walk('SELECT * FROM part_graph', _ONE, 3)} SELECT id, depth FROM reached",
    "reverse_bfs": f"WITH RECURSIVE {_PART}, {_walk('SELECT * FROM part_graph', _ONE, 2, 'dst', 'src')} SELECT id, depth FROM reached",
    "all_depths": f"""WITH RECURSIVE {_FK},
w AS (SELECT id, 0 AS depth FROM (VALUES ('order:1'), ('order:2'), ('order:3')) v(id) UNION ALL SELECT fk.dst, w.depth + 1 FROM w JOIN fk ON fk.src = w.id WHERE w.depth < 4)
SELECT DISTINCT id, depth FROM w WHERE depth > 0""",
    "neighborhood_nodes": f"WITH {_PART} SELECT DISTINCT id FROM (SELECT '1' AS id UNION ALL SELECT dst FROM part_graph WHERE src = '1' UNION ALL SELECT src FROM part_graph WHERE dst = '1')",
    "neighborhood_edges": f"""WITH {_PART}, hood AS (SELECT '1' AS id UNION SELECT dst FROM part_graph WHERE src = '1' UNION SELECT src FROM part_graph WHERE dst = '1')
SELECT src AS source_id, dst AS target_id, 'next' AS type FROM part_graph WHERE src IN (SELECT id FROM hood) AND dst IN (SELECT id FROM hood)""",
    "find_path_len": f"WITH RECURSIVE {_PART}, {_walk('SELECT * FROM part_graph', _ONE, 10)} SELECT depth AS hops, '1' AS first, '100' AS last FROM reached WHERE id = '100'",
    "callers": _code(5, "calls", True) + " SELECT id, depth FROM reached WHERE depth > 0",
    "callees": _code(5, "calls", False) + " SELECT id, depth FROM reached WHERE depth > 0",
    "dependencies": _code(3, "", False) + " SELECT id, depth FROM reached WHERE depth > 0",
    "transitive_deps": f"WITH RECURSIVE {_LINKS}, {_SEED}, w AS (SELECT id FROM seed UNION SELECT l.dst FROM w JOIN link l ON l.src = w.id) SELECT id FROM w WHERE id NOT IN (SELECT id FROM seed)",
    "impact_risk": _code(4, "", True)
    + """, hit AS (SELECT r.id, r.depth, n.file_path FROM reached r JOIN (SELECT id, any_value(file_path) AS file_path FROM nodes GROUP BY 1) n ON n.id = r.id WHERE r.depth > 0)
SELECT count(*) FILTER (depth = 1) AS direct_dependents, count(*) AS transitive_dependents, count(DISTINCT file_path) AS n_files, coalesce((SELECT string_agg(file_path, ',' ORDER BY file_path) FROM (SELECT DISTINCT file_path FROM hit)), '') AS affected_files,
  CASE WHEN count(*) > 50 THEN 'critical' WHEN count(*) > 20 THEN 'high' WHEN count(*) > 5 THEN 'medium' ELSE 'low' END AS risk FROM hit""",
    "impact_buckets": _code(10, "calls", True) + " SELECT id, depth, CASE WHEN depth <= 1 THEN 'high' WHEN depth <= 3 THEN 'medium' ELSE 'low' END AS impact FROM reached WHERE depth > 0 AND id IN (SELECT id FROM ids)",
    "tests_for": _code(5, "", True)
    + """, tests AS (SELECT id, any_value(file_path) AS file_path, lower(any_value(name)) AS name FROM nodes WHERE is_test = 1 GROUP BY 1),
seen AS (SELECT t.* FROM reached r JOIN tests t USING (id) WHERE r.depth > 0),
named AS (SELECT t.* FROM tests t WHERE EXISTS (SELECT 1 FROM nodes n JOIN seed USING (id) WHERE contains(t.name, lower(n.name)))),
hits AS (SELECT * FROM seen UNION ALL SELECT * FROM named WHERE NOT EXISTS (SELECT 1 FROM seen))
SELECT file_path, string_agg(id, ',' ORDER BY id) AS test_ids FROM hits GROUP BY 1""",
    "pagerank_20": _ranks(20, "SELECT id, 1.0 / (SELECT count(*) FROM ids) AS home FROM ids"),
    "ppr_20": "SELECT * FROM (" + _ranks(20, "SELECT id, CASE WHEN id IN (SELECT id FROM seed) THEN 1.0 ELSE 0.0 END AS home FROM ids").replace("SELECT id, round(rank, 9) AS rank FROM p20", "SELECT id, round(rank, 9) AS rank FROM p20 WHERE rank > 1e-10") + ")",
    "cycles": """WITH RECURSIVE link AS (SELECT DISTINCT source_id AS src, target_id AS dst FROM edges WHERE source_id IS NOT NULL AND source_id <> target_id AND target_id IN (SELECT source_id FROM edges)),
reach AS (SELECT src, dst FROM link UNION SELECT r.src, l.dst FROM reach r JOIN link l ON l.src = r.dst),
mutual AS (SELECT a.src AS id, min(least(a.src, a.dst)) AS component FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY 1)
SELECT component, count(*) AS size FROM mutual GROUP BY 1 HAVING count(*) > 1""",
    "vertex_types": """WITH ids AS (SELECT DISTINCT id FROM nodes), ends AS (SELECT source_id AS id FROM edges WHERE source_id IS NOT NULL UNION SELECT target_id FROM edges WHERE target_id IS NOT NULL)
SELECT vertex_type, count(*) AS n FROM (SELECT 'symbol' AS vertex_type FROM ids UNION ALL SELECT CASE WHEN starts_with(id, 'file:') THEN 'file' WHEN starts_with(id, 'module:') THEN 'module' WHEN starts_with(id, 'unresolved:') THEN 'unresolved' ELSE 'dangling' END
  FROM ends WHERE id NOT IN (SELECT id FROM ids)) GROUP BY 1""",
}
