"""Queries of ingestion, extraction, storage, history, streaming and evaluation, and their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from orrery.functions.paths import canonical_hash, canonical_path
from orrery.operators import evaluate, extract, reports, store
from orrery.session import ensure_checkpoint_dir
from orrery.sources import history, tree
from orrery.sources.tables import table
from orrery.streaming import watch


def _tidy(df):
    return df.select(canonical_path(F.col("file_path")).alias("file_path"), canonical_hash(F.col("content_hash")).alias("content_hash")).where("content_hash is not null").distinct()


def incremental_antijoin(spark, folder):
    return tree.changed(_tidy(table(spark, folder, "file_listing")), _tidy(table(spark, folder, "file_hashes"))).select("file_path", "content_hash")


def removed_files(spark, folder):
    return tree.removed(_tidy(table(spark, folder, "file_listing")), _tidy(table(spark, folder, "file_hashes")))


def detect_language(spark, folder):
    return table(spark, folder, "file_listing").select("file_path").distinct().groupBy(tree.language_of(F.col("file_path")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


def upsert_snapshot(spark, folder):
    h = table(spark, folder, "file_hashes").select(canonical_path(F.col("file_path")).alias("file_path"), "indexed_at", canonical_hash(F.col("content_hash")).alias("content_hash"))
    cut = F.expr("timestamp_ntz '2025-04-01 00:00:00'")
    first = h.where(F.col("indexed_at") < cut).groupBy("file_path").agg(F.max(F.struct("indexed_at", "content_hash")).alias("r")).select("file_path", "r.indexed_at", "r.content_hash")
    return store.upsert(first, h.where(F.col("indexed_at") >= cut), ["file_path"])


def delete_repository(spark, folder):
    s = reports.symbols(table(spark, folder, "nodes")).select("id", "file_path")
    e = table(spark, folder, "edges").select("source_id", "target_id", "type").distinct()
    n, left = store.delete_files(s, e, s.where(F.col("file_path").startswith("harbor-mono/")).select("file_path"))
    return left


def _code(spark, folder):
    return reports.symbols(table(spark, folder, "nodes")).select("id", "type", "name", "file_path", "start_line", "end_line", "exported", "language")


def contains_edges(spark, folder):
    return extract.contains_edges(_code(spark, folder))


def is_test(spark, folder):
    return _code(spark, folder).select("id", extract.is_test(F.col("name"), F.col("file_path"), F.col("language")).alias("is_test"))


def extracted_definitions(spark, folder):
    """Bodies read as files: definitions per language and kind."""
    b = table(spark, folder, "nodes").where("body is not null").groupBy(F.col("id").alias("file_path")).agg(F.max(F.lower("language")).alias("language"), F.first("body").alias("content"))
    return extract.extract(b).where("record = 'def'").groupBy("language", "kind").agg(F.count(F.lit(1)).alias("n"))


def extracted_edges(spark, folder):
    """Bodies read as files: references resolved over all of them, per kind."""
    b = table(spark, folder, "nodes").where("body is not null").groupBy(F.col("id").alias("file_path")).agg(F.max(F.lower("language")).alias("language"), F.first("body").alias("content"))
    found = extract.extract(b)
    return extract.reference_edges(found, extract.nodes_of(found)).groupBy("type", F.startswith("target_id", F.lit("unresolved:")).alias("open")).agg(F.count(F.lit(1)).alias("n"))


def framework_edges(spark, folder):
    b = table(spark, folder, "nodes").groupBy("id").agg(F.first("body").alias("body"))
    return extract.framework_edges(_code(spark, folder).join(b, "id")).groupBy("framework").agg(F.count(F.lit(1)).alias("n"))


def _log(spark, folder):
    """Events as a log: an event is a commit of its user to the file of its kind, at its time."""
    return table(spark, folder, "events").select(F.col("event_id").alias("commit"), F.concat(F.lit("u"), F.col("user_id")).alias("author"), F.col("user_id").cast("string").alias("email"), F.col("ts").alias("date"), F.col("event_type").alias("file_path"), F.floor("value").cast("long").alias("added"), F.lit(1).alias("deleted"))


def hotspots(spark, folder):
    return history.hotspots(_log(spark, folder))


def contributors(spark, folder):
    return history.contributors(_log(spark, folder))


def window_counts(spark, folder):
    return watch.window_counts(table(spark, folder, "events"), "ts", "event_type")


def stream_window_counts(spark, folder):
    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    return watch.stream_table(spark, f"{folder}/events.parquet", lambda s: watch.window_counts(s, "ts", "event_type"), f"{root}/state", f"{root}/out")


def eval_prf(spark, folder):
    """Types of edges into each target against those out of it, as found and expected sets."""
    e = table(spark, folder, "edges")
    return evaluate.prf(e.select(F.col("target_id").alias("k"), F.col("type").alias("v")).where("k is not null"), e.select(F.col("source_id").alias("k"), F.col("type").alias("v")).where("k is not null"), "k", "v").select("k", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


_ALL = (incremental_antijoin, removed_files, detect_language, upsert_snapshot, delete_repository, contains_edges, is_test, extracted_definitions, extracted_edges, framework_edges, hotspots, contributors, window_counts, stream_window_counts, eval_prf)
QUERIES = {f.__name__: f for f in _ALL}

_PATH = r"regexp_replace(regexp_replace(replace(file_path, chr(92), '/'), '/+', '/', 'g'), '^(\./)+', '')"
_HASH = "nullif(trim(regexp_replace(lower(trim(content_hash)), '^sha256:', '')), '')"
_T = lambda t: f"SELECT DISTINCT {_PATH} AS file_path, {_HASH} AS content_hash FROM {t} WHERE {_HASH} IS NOT NULL"
_S = "s AS (SELECT id, type, name, file_path, start_line, end_line, lower(language) AS language FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC, deleted_at DESC NULLS LAST) AS rn FROM nodes) WHERE rn = 1)"
_W = "SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2"

ORACLES = {
    "incremental_antijoin": f"SELECT * FROM ({_T('file_listing')}) EXCEPT SELECT * FROM ({_T('file_hashes')})",
    "removed_files": f"SELECT DISTINCT file_path FROM ({_T('file_hashes')}) WHERE file_path NOT IN (SELECT file_path FROM ({_T('file_listing')}))",
    "detect_language": "SELECT language, count(*) AS n FROM (SELECT CASE regexp_extract(file_path, '\\.([^./]+)$', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tree.LANGUAGE_OF.items()) + " END AS language FROM (SELECT DISTINCT file_path FROM file_listing)) GROUP BY 1",
    "upsert_snapshot": f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY indexed_at DESC, content_hash DESC) AS rn FROM (SELECT {_PATH} AS file_path, indexed_at, {_HASH} AS content_hash FROM file_hashes)) WHERE rn = 1",
    "delete_repository": f"WITH {_S}, gone AS (SELECT id FROM s WHERE starts_with(file_path, 'harbor-mono/')) SELECT DISTINCT source_id, target_id, type FROM edges WHERE (source_id IS NULL OR source_id NOT IN (SELECT id FROM gone)) AND (target_id IS NULL OR target_id NOT IN (SELECT id FROM gone))",
    "contains_edges": f"""WITH {_S} SELECT source_id, target_id FROM (SELECT c.id AS source_id, m.id AS target_id, row_number() OVER (PARTITION BY m.id ORDER BY c.start_line DESC, c.id DESC) AS r
FROM s m JOIN s c ON c.file_path = m.file_path AND c.start_line <= m.start_line AND m.end_line <= c.end_line AND c.id <> m.id AND c.type IN ('class', 'interface', 'struct', 'trait', 'enum') WHERE m.type = 'method') WHERE r = 1""",
    "is_test": rf"""WITH {_S} SELECT id, CAST(regexp_matches(lower(file_path), '(^|/)(tests?|__tests__|spec)/|[._](test|spec)\.[a-z]+$|(^|/)test_[^/]*\.py$|_test\.(go|py)$|tests?\.java$') OR CASE language WHEN 'python' THEN starts_with(lower(name), 'test_') OR starts_with(name, 'Test')
WHEN 'go' THEN regexp_matches(name, '^(Test|Benchmark|Example)[A-Z_]') WHEN 'java' THEN starts_with(lower(name), 'test') ELSE regexp_matches(lower(name), '^(test|it|describe)_') END AS INT) AS is_test FROM s""",
    "hotspots": "WITH p AS (SELECT event_type AS file_path, count(DISTINCT event_id) AS commits, max(ts) AS last_modified FROM events GROUP BY 1) SELECT *, round(commits / (SELECT max(commits) FROM p), 6) AS score FROM p ORDER BY commits DESC, 1 LIMIT 20",
    "contributors": "SELECT CAST(user_id AS VARCHAR) AS email, 'u' || user_id AS author, count(DISTINCT event_id) AS commits, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS added, count(*) AS deleted FROM events GROUP BY user_id",
    "window_counts": _W,
    "stream_window_counts": _W,
    "eval_prf": """WITH f AS (SELECT DISTINCT target_id AS k, type AS v, 1 AS f FROM edges WHERE target_id IS NOT NULL), e AS (SELECT DISTINCT source_id AS k, type AS v, 1 AS e FROM edges WHERE source_id IS NOT NULL),
n AS (SELECT k, sum(coalesce(f, 0) * coalesce(e, 0)) AS hit, count(f) AS nf, count(e) AS ne FROM f FULL JOIN e USING (k, v) GROUP BY 1), m AS (SELECT k, CASE WHEN nf > 0 THEN hit / nf ELSE 0 END AS p, CASE WHEN ne > 0 THEN hit / ne ELSE 0 END AS r FROM n)
SELECT k, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM m""",
}

_RULE = "CASE " + " ".join(f"WHEN regexp_matches(file_path, '{p}') AND regexp_matches(body, '{b}') THEN '{n}'" for n, p, b in extract.ROUTES) + " END"
ORACLES["framework_edges"] = f"""WITH {_S.replace("lower(language) AS language", "lower(language) AS language, exported, body")},
c AS (SELECT * FROM s WHERE type IN ('function', 'method', 'class')), f AS (SELECT id, file_path, {_RULE} AS framework, body FROM s),
w AS (SELECT DISTINCT id, file_path, framework, unnest(regexp_extract_all(body, '[A-Za-z_$][A-Za-z0-9_$]*')) AS name FROM f WHERE framework IS NOT NULL),
same AS (SELECT name, file_path, arg_min(id, (start_line, id)) AS target FROM c GROUP BY 1, 2), out_ AS (SELECT name, arg_min(id, (file_path, start_line, id)) AS target FROM c WHERE exported GROUP BY 1), any_ AS (SELECT name, arg_min(id, (file_path, start_line, id)) AS target FROM c GROUP BY 1),
r AS (SELECT w.id, w.framework, coalesce(same.target, out_.target, any_.target) AS target FROM w JOIN any_ USING (name) LEFT JOIN out_ USING (name) LEFT JOIN same ON same.name = w.name AND same.file_path = w.file_path)
SELECT framework, count(*) AS n FROM (SELECT DISTINCT id, target, framework FROM r WHERE id <> target) GROUP BY 1"""
