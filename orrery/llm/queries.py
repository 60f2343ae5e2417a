"""Named queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import abuse, credentials, docpairs, mixing, provenance, shared_spans, tokens


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans.SharedSpans(_table(spark, folder, "nodes")).pairs()


def p1_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans.SharedSpans(_table(spark, folder, "nodes")).coverage()


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans.SharedSpans(_table(spark, folder, "nodes")).groups()


def p1_copies(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans.SharedSpans(_table(spark, folder, "nodes")).copies()


def p1_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans.SharedSpans(_table(spark, folder, "nodes")).cleaned()


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return docpairs.documented(_table(spark, folder, "nodes"))


def p3_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return docpairs.pairs(_table(spark, folder, "nodes"))


def _both(spark: SparkSession, folder: str, run) -> DataFrame:
    nodes = run(_table(spark, folder, "nodes"), "id", "body").withColumn("src_table", F.lit("nodes"))
    findings = run(_table(spark, folder, "security_findings"), "finding_id", "matched_text").withColumn("src_table", F.lit("security_findings"))
    return nodes.unionByName(findings)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _both(spark, folder, credentials.credentials).select("src_table", "rec_id", "line_no")


def p5_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return _both(spark, folder, credentials.redacted).select("src_table", "rec_id", "redacted")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_kinds(spark, folder).where("kind <> 'hand-written'").select("file_path")


def p6_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return provenance.classify_files(_table(spark, folder, "file_hashes"), _table(spark, folder, "nodes"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_corpus(_table(spark, folder, "documents"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents"), _table(spark, folder, "source_targets"))[1]


def p9_marginals(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents"), _table(spark, folder, "source_targets"))[2]


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents"), _table(spark, folder, "source_targets"))[0]


def _scores(spark: SparkSession, folder: str) -> abuse.AbuseScores:
    return abuse.AbuseScores(_table(spark, folder, "documents"), _table(spark, folder, "review_labels"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return _scores(spark, folder).found()


def p10_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _scores(spark, folder).scores()


def p10_rates(spark: SparkSession, folder: str) -> DataFrame:
    return _scores(spark, folder).rates()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (p1_found, p1_groups, p1_copies, p1_coverage, p1_cleaned, p3_found, p3_pairs, p5_found, p5_redacted, p6_found, p6_kinds, p8_ids, p9_shares, p9_marginals, p9_mix, p10_found, p10_scores, p10_rates)
    return {f.__name__: f for f in own}


_BODIES = "b AS (SELECT DISTINCT id, md5(body) AS c, body FROM nodes WHERE id IS NOT NULL AND length(body) >= 200), k AS (SELECT DISTINCT c, body FROM b), g AS (SELECT c, p, md5(substr(body, p, 200)) AS h FROM k, unnest(range(1, length(body) - 198)) t(p))"


def oracle_sql() -> dict[str, str]:
    """Brute force over every 200 characters for problem 1; SQL can't say what the others do: see the tests."""
    return {
        "p1_found": f"""WITH {_BODIES}, s AS (SELECT DISTINCT c, h FROM g WHERE h IN (SELECT h FROM g GROUP BY 1 HAVING count(DISTINCT c) > 1)), pair AS (SELECT DISTINCT x.c AS a, y.c AS z FROM s x JOIN s y ON x.h = y.h AND x.c < y.c UNION ALL SELECT c, c FROM k)
SELECT DISTINCT least(x.id, y.id) AS id_a, greatest(x.id, y.id) AS id_b FROM pair JOIN b x ON x.c = a JOIN b y ON y.c = z WHERE x.id <> y.id""",
        "p1_copies": "WITH b AS (SELECT DISTINCT id, body FROM nodes WHERE id IS NOT NULL AND length(body) >= 200) SELECT id, min(id) OVER (PARTITION BY body) AS class_id, count(*) OVER (PARTITION BY body) AS n_copies FROM b",
        "p1_coverage": f"""WITH {_BODIES}, w AS (SELECT c, p, lag(p) OVER (PARTITION BY c ORDER BY p) AS q FROM g WHERE h IN (SELECT h FROM g GROUP BY 1 HAVING count(DISTINCT c) > 1)),
own AS (SELECT c, count(*) FILTER (q IS NULL OR p > q + 200) AS n, sum(CASE WHEN q IS NULL OR p > q + 200 THEN 200 ELSE p - q END) AS chars FROM w GROUP BY 1),
m AS (SELECT id, length(body) AS size, count(*) OVER (PARTITION BY b.c) > 1 AS copied, n, chars FROM b LEFT JOIN own USING (c))
SELECT id, max(CASE WHEN copied THEN 1 ELSE n END) AS n_stretches, CAST(max(CASE WHEN copied THEN size ELSE chars END) AS BIGINT) AS shared_chars, max(round(CASE WHEN copied THEN 1.0 ELSE chars / size END, 6)) AS share FROM m WHERE copied OR chars IS NOT NULL GROUP BY 1""",
    }
