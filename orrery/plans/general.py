"""Queries of the general problems 2, 4 and 7, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import incremental, orphans, skew
from orrery.session import new_folder
from orrery.sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """One run of the processor: the files of its committed batch."""
    tables = (table(spark, folder, t) for t in ("file_listing", "file_hashes", "index_runs"))
    return incremental.changed_files(*tables, root=new_folder(spark)).select("file_path").distinct()


def p2_reread_from(spark: SparkSession, folder: str) -> DataFrame:
    return incremental.low_water_mark(table(spark, folder, "index_runs"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return skew.heavy_keys(table(spark, folder, "edges")).select("target_id", "type")


def p4_degrees(spark: SparkSession, folder: str) -> DataFrame:
    return skew.in_degrees(table(spark, folder, "edges"))


def p4_typed_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Every edge with the skewed in-degree of its target and type, joined by fragment and replicate."""
    edges = table(spark, folder, "edges").select("id", "target_id", "type")
    degrees = edges.groupBy("target_id", "type").agg(F.count(F.lit(1)).alias("in_degree"))
    return skew.skew_join(edges, degrees, ["target_id", "type"]).select("id", "target_id", "type", "in_degree")


def _orphans(spark: SparkSession, folder: str) -> orphans.OrphanReferences:
    return orphans.OrphanReferences(*(table(spark, folder, t) for t in ("edges", "unresolved_refs", "nodes", "file_hashes")))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """The direct ones of all orphan references, direct and inherited."""
    return _orphans(spark, folder).references().where("kind = 'direct'").select("src_table", "ref_id", "side")


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).report()


def p7_cascade(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).records


QUERIES = {f.__name__: f for f in (p2_found, p2_reread_from, p4_found, p4_degrees, p4_typed_edges, p7_found, p7_report, p7_cascade)}


def _canonical(path: str) -> str:
    return rf"regexp_replace(regexp_replace(replace({path}, '\', '/'), '/+', '/', 'g'), '^(\./)+', '')"


def _digest(x: str) -> str:
    return f"nullif(trim(regexp_replace(lower(trim({x})), '^sha256:', '')), '')"


_SUFFIX_LIST = "[" + ", ".join(f"'{s}'" for s in ["", *orphans.SUFFIXES]) + "]"

_P7 = f"""
WITH life AS (SELECT DISTINCT id, indexed_at, deleted_at FROM nodes),
seen AS (SELECT {_canonical("file_path")} AS p, min(indexed_at) AS seen FROM file_hashes GROUP BY 1),
refs AS (SELECT id, 'source' AS side, source_id AS ref, indexed_at AS at_ts FROM edges UNION ALL SELECT id, 'target', target_id, indexed_at FROM edges),
kept AS (SELECT DISTINCT * FROM refs WHERE ref IS NOT NULL AND NOT starts_with(ref, 'module:') AND NOT starts_with(ref, 'unresolved:')),
of_nodes AS (SELECT id, side, at_ts FROM kept k WHERE NOT starts_with(ref, 'file:') AND NOT EXISTS (SELECT 1 FROM life l WHERE l.id = k.ref AND l.indexed_at <= k.at_ts AND (l.deleted_at IS NULL OR k.at_ts < l.deleted_at))),
of_files AS (SELECT id, side, at_ts FROM kept k WHERE starts_with(ref, 'file:') AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.p = {_canonical("substr(k.ref, 6)")} AND s.seen <= k.at_ts)),
spec AS (SELECT DISTINCT id, seen_at, CASE WHEN starts_with(specifier, './') OR starts_with(specifier, '../') THEN regexp_extract({_canonical("file_path")}, '^(.*)/[^/]*$', 1) || '/' || specifier
  WHEN starts_with(specifier, '@/') OR starts_with(specifier, '~/') THEN string_split({_canonical("file_path")}, '/')[1] || '/src/' || substr(specifier, 3) END AS raw FROM unresolved_refs),
parts AS (SELECT id, seen_at, list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split(replace(raw, chr(92), '/'), '/'), lambda x: [x])),
  lambda acc, x: CASE WHEN x[1] IN ('', '.') THEN acc WHEN x[1] = '..' THEN acc[1:greatest(len(acc) - 1, 0)] ELSE list_concat(acc, x) END) AS segs FROM spec WHERE raw IS NOT NULL),
paths AS (SELECT id, seen_at, array_to_string(segs, '/') AS p FROM parts),
tried AS (SELECT id, seen_at, p || unnest({_SUFFIX_LIST}) AS p FROM paths),
of_specs AS (SELECT DISTINCT id, seen_at AS at_ts FROM paths WHERE id NOT IN (SELECT t.id FROM tried t JOIN seen s ON s.p = t.p AND s.seen <= t.seen_at)),
orphan AS (SELECT 'edges' AS src_table, id AS ref_id, side, at_ts FROM of_nodes UNION ALL SELECT 'edges', id, side, at_ts FROM of_files UNION ALL SELECT 'unresolved_refs', id, 'specifier', at_ts FROM of_specs)
"""

_FALL = """
, lost AS (SELECT DISTINCT k.ref FROM kept k JOIN orphan o ON o.src_table = 'edges' AND o.ref_id = k.id AND o.side = k.side AND o.at_ts IS NOT DISTINCT FROM k.at_ts),
tree AS (SELECT DISTINCT source_id, target_id FROM edges WHERE type = 'contains' AND source_id IS NOT NULL AND target_id IS NOT NULL),
walk AS (WITH RECURSIVE w AS (SELECT DISTINCT ref AS node_id, 0 AS depth FROM lost JOIN tree ON source_id = ref
  UNION SELECT t.target_id, w.depth + 1 FROM w JOIN tree t ON t.source_id = w.node_id WHERE w.depth < 40) SELECT * FROM w),
fall AS (SELECT node_id, CAST(min(depth) AS INT) AS depth, CASE WHEN min(depth) = 0 THEN 'direct' ELSE 'inherited' END AS kind FROM walk GROUP BY 1)
"""

ORACLES = {
    "p2_found": f"""
WITH listed AS (SELECT {_canonical("file_path")} AS file_path, {_digest("content_hash")} AS h, listed_at, listing_id FROM file_listing),
current AS (SELECT file_path, arg_max(h, (listed_at, listing_id)) AS h FROM listed WHERE h IS NOT NULL GROUP BY 1),
sound AS (SELECT {_canonical("f.file_path")} AS file_path, {_digest("f.content_hash")} AS h, f.indexed_at FROM file_hashes f
  WHERE EXISTS (SELECT 1 FROM index_runs r WHERE r.status = 'ok' AND f.indexed_at BETWEEN r.started_at AND r.finished_at)),
stored AS (SELECT file_path, arg_max(h, (indexed_at, h)) AS h FROM sound WHERE h IS NOT NULL GROUP BY 1)
SELECT file_path FROM current c WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.file_path = c.file_path AND s.h = c.h)""",
    "p2_reread_from": """
WITH last AS (SELECT max(finished_at) AS t FROM index_runs WHERE status = 'ok')
SELECT min(started_at) AS reread_from FROM index_runs, last WHERE started_at <= t AND (finished_at IS NULL OR finished_at >= t)""",
    "p4_found": "SELECT target_id, type FROM edges GROUP BY 1, 2 HAVING count(*) >= 0.01 * (SELECT count(*) FROM edges)",
    "p4_degrees": "SELECT target_id, type, count(*) AS in_degree, count(DISTINCT source_id) AS distinct_sources FROM edges GROUP BY 1, 2",
    "p4_typed_edges": "SELECT id, target_id, type, count(*) OVER (PARTITION BY target_id, type) AS in_degree FROM edges WHERE target_id IS NOT NULL AND type IS NOT NULL",
    "p7_found": _P7 + "SELECT DISTINCT src_table, ref_id, side FROM orphan",
    "p7_cascade": _P7 + _FALL + "SELECT node_id, depth, kind FROM fall",
    "p7_report": _P7
    + _FALL
    + """, heirs AS (SELECT node_id FROM fall WHERE kind = 'inherited'),
via AS (SELECT DISTINCT 'edges' AS src_table, id AS ref_id, side, at_ts FROM kept WHERE ref IN (SELECT node_id FROM heirs) AND (id, side) NOT IN (SELECT (ref_id, side) FROM orphan WHERE src_table = 'edges')),
own AS (SELECT DISTINCT 'unresolved_refs' AS src_table, id AS ref_id, 'source' AS side, source_id, seen_at AS at_ts FROM unresolved_refs WHERE source_id IN (SELECT ref FROM lost) OR source_id IN (SELECT node_id FROM heirs)),
every_ AS (SELECT src_table, at_ts, 'direct' AS kind FROM (SELECT DISTINCT * FROM orphan) UNION ALL SELECT src_table, at_ts, 'inherited' FROM via UNION ALL SELECT src_table, at_ts, 'inherited' FROM own)
SELECT src_table, strftime(at_ts, '%Y-%m') AS month, kind, count(*) AS n_refs FROM every_ GROUP BY ALL""",
}
