"""Queries of the relational reports, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import reports
from orrery.plans.graph_queries import _LINKS, _SEED, first_symbol
from orrery.sources.tables import table


def _t(spark, folder, *names):
    return [table(spark, folder, n) for n in names]


def stats(spark, folder):
    return reports.stats(*_t(spark, folder, "nodes", "edges", "unresolved_refs"))


def languages(spark, folder):
    return reports.languages(*_t(spark, folder, "nodes", "edges"))


def languages_by_files(spark, folder):
    return reports.languages_by_files(*_t(spark, folder, "file_hashes"))


def structure_kinds(spark, folder):
    return reports.kinds(*_t(spark, folder, "nodes"), prefix="harbor-mono/")


def project_tree(spark, folder):
    return reports.project_tree(*_t(spark, folder, "nodes"))


def structure_directories(spark, folder):
    return reports.top_directories(*_t(spark, folder, "nodes"))


def export_map(spark, folder):
    return reports.export_map(*_t(spark, folder, "nodes"))


def file_symbols(spark, folder):
    nodes = table(spark, folder, "nodes")
    first = nodes.agg(F.min("file_path").alias("p")).select("p")
    s = reports.symbols(nodes)
    return s.join(F.broadcast(first), s.file_path == first.p, "left_semi").select("id", "type", "name", "start_line", "end_line")  # one row


def find_references(spark, folder):
    return reports.find_references(*_t(spark, folder, "nodes", "edges"), first_symbol(spark, folder))


def module_graph(spark, folder):
    return reports.module_graph(*_t(spark, folder, "nodes", "edges"))


def import_graph(spark, folder):
    return reports.import_graph(*_t(spark, folder, "nodes", "edges"))


def dead_code(spark, folder):
    return reports.dead_code(*_t(spark, folder, "nodes", "edges"))


def dead_functions_exported(spark, folder):
    return reports.dead_code(*_t(spark, folder, "nodes", "edges"), ["function", "method"], include_exported=True)


def top_indegree(spark, folder):
    return reports.top_nodes(*_t(spark, folder, "nodes", "edges"), 200)


def list_edges(spark, folder):
    return reports.list_edges(*_t(spark, folder, "edges"))


def suggest_symbols(spark, folder):
    return reports.suggest_symbols(*_t(spark, folder, "nodes"), "Ledger")


def node_detail(spark, folder):
    return reports.node_detail(*_t(spark, folder, "nodes", "edges"), first_symbol(spark, folder))


def source_hashes(spark, folder):
    return table(spark, folder, "nodes").select("id").distinct().select("id", reports.source_hash(F.col("id")).alias("hash")).groupBy(F.length("hash").alias("digits")).agg(F.count(F.lit(1)).alias("n"))


def prefix_context(spark, folder):
    prefixes = spark.createDataFrame([("harbor-mono", "main repository"), ("harbor-mono/src", "its sources"), ("amber-api", "interface")], "prefix string, description string")
    paths = table(spark, folder, "nodes").select(F.col("file_path").alias("path"))
    return reports.longest_prefix(paths, prefixes).groupBy("description").agg(F.count(F.lit(1)).alias("n_paths"))


QUERIES = {f.__name__: f for f in (stats, languages, languages_by_files, structure_kinds, project_tree, structure_directories, export_map, file_symbols, find_references, module_graph, import_graph, dead_code, dead_functions_exported, top_indegree, list_edges, suggest_symbols, node_detail, source_hashes, prefix_context)}

_S = """s AS (SELECT id, type, name, qualified_name, file_path, start_line, end_line, lower(language) AS language, signature, doc_comment, is_test, exported, deleted_at
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC, deleted_at DESC NULLS LAST) AS rn FROM nodes) WHERE rn = 1)"""
_FILES = """files AS (SELECT id, min(file_path) AS f FROM nodes GROUP BY 1),
pairs AS (SELECT DISTINCT coalesce(CASE WHEN starts_with(source_id, 'file:') THEN substr(source_id, 6) END, a.f) AS from_file, coalesce(CASE WHEN starts_with(target_id, 'file:') THEN substr(target_id, 6) END, b.f) AS to_file
  FROM edges e LEFT JOIN files a ON a.id = e.source_id LEFT JOIN files b ON b.id = e.target_id {where})"""


def _dead(more: str) -> str:
    return f"""WITH {_S} SELECT id, name, file_path, start_line FROM s WHERE type NOT IN ('module', 'namespace') AND lower(name) <> 'main' AND coalesce(is_test, 0) = 0 {more}
AND name NOT ILIKE 'test%' AND file_path NOT ILIKE '%.test.%' AND file_path NOT ILIKE '%.spec.%' AND NOT contains(lower(file_path), '__tests__') AND id NOT IN (SELECT target_id FROM edges WHERE target_id IS NOT NULL)"""


ORACLES = {
    "stats": "SELECT (SELECT count(DISTINCT id) FROM nodes) AS n_nodes, (SELECT count(DISTINCT file_path) FROM nodes) AS n_files, (SELECT count(DISTINCT id) FROM edges) AS n_edges, (SELECT count(DISTINCT id) FROM unresolved_refs) AS n_unresolved",
    "languages": f"""WITH {_S}, o AS (SELECT source_id AS id, count(DISTINCT id) AS n FROM edges GROUP BY 1)
SELECT language, count(DISTINCT file_path) AS n_files, count(*) AS n_symbols, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_out_edges, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS share FROM s LEFT JOIN o USING (id) GROUP BY 1""",
    "languages_by_files": "SELECT coalesce(lower(language), 'unknown') AS language, count(*) AS n FROM file_hashes GROUP BY 1",
    "structure_kinds": f"WITH {_S} SELECT type, count(*) AS n FROM s WHERE starts_with(file_path, 'harbor-mono/') GROUP BY 1",
    "project_tree": f"""WITH {_S}, d AS (SELECT *, CASE WHEN regexp_replace(file_path, '/?[^/]*$', '') = '' THEN '.' ELSE regexp_replace(file_path, '/?[^/]*$', '') END AS directory FROM s)
SELECT directory, count(DISTINCT file_path) AS n_files, count(*) AS n_symbols FROM d WHERE length(directory) - length(replace(directory, '/', '')) < 3 GROUP BY 1""",
    "structure_directories": f"WITH {_S} SELECT regexp_replace(file_path, '/?[^/]*$', '') AS directory, count(DISTINCT file_path) AS n_files FROM s GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "export_map": f"WITH {_S} SELECT file_path, string_agg(name, ',' ORDER BY start_line, name) AS names FROM s WHERE coalesce(exported, false) GROUP BY 1",
    "file_symbols": f"WITH {_S} SELECT id, type, name, start_line, end_line FROM s WHERE file_path = (SELECT min(file_path) FROM nodes)",
    "find_references": f"""WITH {_LINKS}, {_SEED}, d AS (SELECT DISTINCT source_id, target_id, type FROM edges)
SELECT source_id AS id, target_id AS other, type, 'outgoing' AS direction FROM d WHERE source_id IN (SELECT id FROM seed) AND target_id IN (SELECT id FROM ids)
UNION ALL SELECT target_id, source_id, type, 'incoming' FROM d WHERE target_id IN (SELECT id FROM seed) AND source_id IN (SELECT id FROM ids)""",
    "module_graph": f"WITH {_FILES.format(where='')} SELECT from_file, to_file FROM pairs WHERE from_file <> to_file",
    "import_graph": "WITH " + _FILES.format(where="WHERE e.type = 'imports'") + " SELECT from_file, to_file FROM pairs WHERE from_file <> to_file",
    "dead_code": _dead("AND NOT coalesce(exported, false)"),
    "dead_functions_exported": _dead("AND type IN ('function', 'method')"),
    "top_indegree": f"""WITH {_S}, i AS (SELECT target_id AS id, count(source_id) AS n FROM (SELECT DISTINCT target_id, source_id, type FROM edges) GROUP BY 1)
SELECT id, coalesce(n, 0) AS in_degree FROM s LEFT JOIN i USING (id) ORDER BY 2 DESC, 1 LIMIT 200""",
    "list_edges": "SELECT DISTINCT source_id, target_id, type FROM edges ORDER BY 1 NULLS FIRST, 2, 3 LIMIT 500",
    "suggest_symbols": f"WITH {_S} SELECT id, name, file_path FROM s WHERE contains(lower(name), 'ledger') ORDER BY name, id LIMIT 10",
    "node_detail": f"""WITH {_LINKS}, {_SEED}, {_S}, d AS (SELECT DISTINCT source_id, target_id, type FROM edges)
SELECT id, type, name, file_path, (SELECT count(*) FROM d WHERE target_id = s.id) AS n_in, (SELECT count(*) FROM d WHERE source_id = s.id) AS n_out FROM s WHERE id IN (SELECT id FROM seed)""",
    "prefix_context": """SELECT description, count(*) AS n_paths FROM (SELECT DISTINCT file_path, CASE WHEN starts_with(file_path, 'harbor-mono/src/') THEN 'its sources' WHEN starts_with(file_path, 'harbor-mono/') THEN 'main repository' WHEN starts_with(file_path, 'amber-api/') THEN 'interface' END AS description FROM nodes) WHERE description IS NOT NULL GROUP BY 1""",
}

_LETTERS = "0123456789abcdefghijklmnopqrstuvwxyz"
ORACLES["source_hashes"] = f"""WITH i AS (SELECT DISTINCT id FROM nodes), h AS (SELECT id, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(id, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda a, c: (a * 31 + c) % 4294967296) AS u FROM i),
s AS (SELECT id, CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END AS h FROM h), b AS (SELECT h, array_to_string(list_transform(range(0, 7), lambda k: substr('{_LETTERS}', CAST((abs(h) // CAST(pow(36, 6 - k) AS BIGINT)) % 36 + 1 AS BIGINT), 1)), '') AS d FROM s)
SELECT CAST(length(CASE WHEN h < 0 THEN '-' ELSE '' END || CASE WHEN ltrim(d, '0') = '' THEN '0' ELSE ltrim(d, '0') END) AS INT) AS digits, count(*) AS n FROM b GROUP BY 1"""
