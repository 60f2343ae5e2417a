"""Queries of retrieval, security and context, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions import text
from orrery.operators import context, reports, search, security
from orrery.plans.text_queries import _bodies
from orrery.session import new_folder
from orrery.sources.tables import table

QUERY = "graph index missing edges"
SYMBOL_QUERY = "validateCfg token ledger"


def _documents(spark, folder):
    return table(spark, folder, "documents")


def _round(df):
    return df.withColumn("score", F.round("score", 6))


def bm25_topk(spark, folder):
    return _round(search.bm25(_documents(spark, folder), "doc_id", {"text": 1.0}, QUERY, 20))


def _symbols(spark, folder):
    nodes = table(spark, folder, "nodes")
    tokens = nodes.groupBy("id").agg(F.max("name_tokens").alias("name_tokens"))
    return reports.symbols(nodes).join(tokens, "id")


def bm25_postings(spark, folder):
    """The same answer from an inverted index, which is built here and of which the query's postings are read."""
    index = search.Postings.build(_documents(spark, folder), "doc_id", {"text": 1.0}, new_folder(spark))
    return _round(index.search(QUERY, 20))


def keyword_symbols(spark, folder):
    return _round(search.bm25(_symbols(spark, folder), "id", search.SYMBOL_FIELDS, SYMBOL_QUERY, 20))


def hybrid_symbols(spark, folder):
    return _round(search.hybrid(_symbols(spark, folder), "id", search.SYMBOL_FIELDS, SYMBOL_QUERY, 20))


def search_files(spark, folder):
    s = _symbols(spark, folder)
    return search.search_files(search.bm25(s, "id", search.SYMBOL_FIELDS, SYMBOL_QUERY), s, 20).withColumn("total", F.round("total", 6))


def workspace_search(spark, folder):
    s = _symbols(spark, folder)
    hits = search.bm25(s, "id", search.SYMBOL_FIELDS, SYMBOL_QUERY)
    return _round(search.workspace_search(hits, s.select("id", F.element_at(F.split("file_path", "/"), 1).alias("repo")), 3))


def knn_cosine(spark, folder):
    v = table(spark, folder, "embeddings")
    return search.knn(v, v.where("vec_id % 20 = 0"), "vec_id", "embedding", 10).withColumn("similarity", F.round("similarity", 5)).select("query_id", "rank", "similarity")


def rrf_fusion(spark, folder):
    d = _documents(spark, folder)
    a, b = search.ranked(search.bm25(d, "doc_id", {"text": 1.0}, "graph index", 50), 50), search.ranked(search.bm25(d, "doc_id", {"text": 1.0}, "missing edges", 50), 50)
    return _round(search.rrf([(a, 1.0, True), (b, 1.0, True)]))


def rrf_weighted(spark, folder):
    d = _documents(spark, folder)
    a, b = search.ranked(search.bm25(d, "doc_id", {"text": 1.0}, "graph index", 50), 50), search.ranked(search.bm25(d, "doc_id", {"text": 1.0}, "missing edges", 50), 50)
    return _round(search.rrf([(a, 0.8, True), (b, 0.2, True), (b, 0.4, False)]))


def expand_terms(spark, folder):
    return spark.createDataFrame([(q, i, t) for q in ("auth cfg", "removeUser", "load", "") for i, t in enumerate(search.expand(q))], "query string, place int, term string")


def intents(spark, folder):
    return spark.createDataFrame([(q, search.intent(q)) for q in ("parse_config", "UserService", "how does the login work", "load file", "a::b", "", "find all the callers of x")], "query string, intent string")


def snippets(spark, folder):
    return reports.symbols(table(spark, folder, "nodes")).select("id", text.snippet(F.col("doc_comment"), F.col("signature"), F.col("name")).alias("snippet"))


def identifier_words(spark, folder):
    names = table(spark, folder, "nodes").select("name").distinct()
    return names.select(F.explode(text.split_identifier(F.col("name"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def token_estimate(spark, folder):
    return _documents(spark, folder).select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


def pack_budget(spark, folder):
    d = _documents(spark, folder).select("doc_id", F.coalesce(F.lower(F.trim("source")), F.lit("")).alias("source"), text.token_estimate(F.col("text")).alias("tokens")).distinct()
    return context.pack(d, "source", "doc_id", "tokens", 500).select("source", "doc_id", "used")


def truncate_fit(spark, folder):
    return context.truncate_fit(_bodies(spark, folder), "id", "body", 60).select("key", "tokens", F.length("text").alias("n_chars"))


def signatures(spark, folder):
    return _bodies(spark, folder).select("id", text.signature_only(F.col("body")).alias("signature"))


def context_document(spark, folder):
    doc = context.assemble(table(spark, folder, "nodes"), table(spark, folder, "edges"), SYMBOL_QUERY, 2000)
    return spark.createDataFrame([(i, line) for i, line in enumerate(doc.split("\n"), 1)], "line_no int, line string")


def rule_findings(spark, folder):
    b = _bodies(spark, folder)
    return security.scan(b, "id", "body").select("key", "line_no", "column_no", "rule_id", "matched_text")


def owasp_findings(spark, folder):
    rows = table(spark, folder, "nodes").where("body is not null").groupBy("id").agg(F.first("body").alias("content"), F.max(F.lower("language")).alias("language"), F.max("file_path").alias("file_path"))
    found = security.scan(rows.where(~security.is_test_path(F.col("file_path"))), "id", "content", "language", security.owasp_rules())
    return found.groupBy("owasp", "cwe", "severity").agg(F.count(F.lit(1)).alias("n"))


def finding_summary(spark, folder):
    return security.severity_summary(table(spark, folder, "security_findings").distinct())


def scan_summary(spark, folder):
    return security.severity_summary(security.scan(_bodies(spark, folder), "id", "body"))


def top_rules(spark, folder):
    return security.top_rules(security.scan(_bodies(spark, folder), "id", "body"))


def redact_secrets(spark, folder):
    return table(spark, folder, "security_findings").select("finding_id", "matched_text").distinct().select("finding_id", security.redact(F.col("matched_text")).alias("masked"))


def _by_language(spark, folder):
    return table(spark, folder, "nodes").where("body is not null").groupBy("id").agg(F.first("body").alias("body"), F.max(F.lower("language")).alias("language"))


def taint_sources(spark, folder):
    return security.taint_sources(_by_language(spark, folder), "id", "body", "language")


def taint_sinks(spark, folder):
    return security.taint_sinks(_by_language(spark, folder), "id", "body", "language")


def find_injections(spark, folder):
    return security.find_injections(_by_language(spark, folder), "id", "body", "language")


def trace_taint(spark, folder):
    """Flows from every source of input, with those that are made safe on the way."""
    return security.find_injections(_by_language(spark, folder), "id", "body", "language", keep_sanitized=True)


_ALL = (bm25_topk, bm25_postings, keyword_symbols, hybrid_symbols, search_files, workspace_search, knn_cosine, rrf_fusion, rrf_weighted, expand_terms, intents, snippets, identifier_words, token_estimate, pack_budget, truncate_fit, signatures, context_document, rule_findings, owasp_findings, finding_summary, scan_summary, top_rules, redact_secrets, taint_sources, taint_sinks, find_injections, trace_taint)
QUERIES = {f.__name__: f for f in _ALL}


def _sql_terms(x: str) -> str:
    return rf"list_filter(string_split_regex(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


def _sql_bm25(name: str, source: str, key: str, fields: dict[str, float], query: str | list[str]) -> str:
    """CTEs that end in `name` (id, score) over all matching rows."""
    wanted = search.query_terms(query) if isinstance(query, str) else list(dict.fromkeys(query))
    tf = [" + ".join(f"{w} * len(list_filter(t{i}, lambda x: x = '{t}'))" for i, w in enumerate(fields.values())) for t in wanted]
    f = lambda k: f"greatest(ln((n - n{k} + 0.5) / (n{k} + 0.5)), 1e-6) * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * dl / mean))"
    return f"""{name}_t AS (SELECT {key} AS id, {", ".join(f"{_sql_terms(x)} AS t{i}" for i, x in enumerate(fields))} FROM {source} WHERE {key} IS NOT NULL),
{name}_f AS (SELECT id, {" + ".join(f"len(t{i})" for i in range(len(fields)))} AS dl, {", ".join(f"{x} AS f{k}" for k, x in enumerate(tf))} FROM {name}_t),
{name}_n AS (SELECT count(*) AS n, avg(dl) AS mean, {", ".join(f"count(*) FILTER (f{k} > 0) AS n{k}" for k in range(len(wanted)))} FROM {name}_f),
{name} AS (SELECT id, {" + ".join(f(k) for k in range(len(wanted)))} AS score FROM {name}_f, {name}_n WHERE {" OR ".join(f"f{k} > 0" for k in range(len(wanted)))})"""


_S = """tok AS (SELECT id, max(name_tokens) AS name_tokens FROM nodes GROUP BY 1),
s AS (SELECT n.* EXCLUDE (name_tokens, rn), t.name_tokens FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC, deleted_at DESC NULLS LAST) AS rn FROM nodes) n JOIN tok t USING (id) WHERE rn = 1)"""
_D = {"text": 1.0}
_RRF = f"""WITH {_sql_bm25("a", "documents", "doc_id", _D, "graph index")}, {_sql_bm25("b", "documents", "doc_id", _D, "missing edges")},
ra AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM a QUALIFY r <= 50), rb AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM b QUALIFY r <= 50),
bonus AS (SELECT * FROM (VALUES (1, 0.05), (2, 0.02), (3, 0.02)) v(r, x))"""
_B = "b AS (SELECT id, any_value(body) AS body, max(lower(language)) AS language FROM nodes WHERE body IS NOT NULL GROUP BY 1), l AS (SELECT id AS key, language, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS line_no, rtrim(unnest(string_split(body, chr(10))), chr(13)) AS line FROM b)"
_quote = lambda x: "'" + x.replace("'", "''") + "'"
_RULES = "r AS (SELECT * FROM (VALUES " + ", ".join(f"({_quote(r[0])}, {_quote(r[2])}, {_quote(r[6])})" for r in security.RULES) + ") v(rule_id, severity, pattern))"
#: Matches over whole texts: what stands between them gives their offsets, and these the line and the column.
_WHOLE = """m AS (SELECT key, language, file_path, rule_id, severity, body, regexp_extract_all(body, pattern) AS hits, string_split_regex(body, pattern) AS gaps FROM (SELECT id AS key, body, language, file_path FROM b), r WHERE regexp_matches(body, pattern){only}),
h AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m),
o AS (SELECT *, substr(body, 1, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT)) AS before FROM h),
f AS (SELECT key, language, file_path, CAST(length(before) - length(replace(before, chr(10), '')) + 1 AS INT) AS line_no, CAST(length(string_split(before, chr(10))[-1]) + 1 AS INT) AS column_no, rule_id, severity, hits[i] AS matched_text FROM o)"""
_BF = "b AS (SELECT id, any_value(body) AS body, max(lower(language)) AS language, max(file_path) AS file_path FROM nodes WHERE body IS NOT NULL GROUP BY 1)"
_HITS = f"WITH {_BF}, {_RULES}, " + _WHOLE.format(only="")
_OWASP_RULES = "r AS (SELECT * FROM (VALUES " + ", ".join(f"({_quote(r[0])}, {_quote(r[2])}, {_quote(r[6])}, {_quote(r[3])}, {_quote(r[4])}, {_quote(r[5])})" for r in security.owasp_rules()) + ") v(rule_id, severity, pattern, cwe, owasp, languages))"
_NO_TEST = r"(^|/)(tests?|__tests__|spec|fixtures?|testdata|mocks?)/|(^|/)test_[^/]*$|[._-](test|spec|tests)\.[^/]*$"
_COUNTS = ", ".join(f"count(*) FILTER (lower(severity) = '{s}') AS {s}" for s in security.SEVERITIES)
_RISK = "CASE WHEN critical > 0 THEN 'CRITICAL' WHEN high > 0 THEN 'HIGH' WHEN medium > 0 THEN 'MEDIUM' WHEN low > 0 THEN 'LOW' ELSE 'NONE' END AS risk"


def _sql_patterns(tables: list[tuple]) -> str:
    values = ", ".join(f"({_quote(lang)}, {_quote(kind)}, {_quote(p)})" for lang, kind, ps in tables for p in ps)
    return f"WITH {_B}, p AS (SELECT * FROM (VALUES {values}) v(language, kind, pattern)) SELECT key, l.language, CAST(line_no AS INT) AS line_no, kind, pattern FROM l JOIN p ON p.language = l.language AND contains(line, pattern)"


def _sql_redact(x: str) -> str:
    for pattern, by in security.REDACTIONS:
        x = f"regexp_replace({x}, {_quote(pattern)}, {_quote(by.replace('$', chr(92)))}, 'gi')"
    return x


_tokens_of = lambda x: "coalesce(CAST(list_sum(list_transform(regexp_extract_all(coalesce({x}, ''), {p}), lambda x: CASE WHEN x[1] IN ('\"', '''', '`') THEN 1 + ceil(length(x) / 4.0) ELSE 1 END)) AS BIGINT), 0)".format(x=x, p=_quote(text.TOKEN))
_TOKENS = _tokens_of("text")
# the words of the compounds in "validateCfg token ledger", their long forms and their synonyms, as the expansion has to give them
_MORE = ["validate", "check", "verify", "test", "assert", "cfg", "configuration"]
_ASKED = "q(query) AS (VALUES ('parse_config'), ('UserService'), ('how does the login work'), ('load file'), ('a::b'), (''), ('find all the callers of x'))"
ORACLES = {
    "hybrid_symbols": f"""WITH {_S}, {_sql_bm25("a", "s", "id", search.SYMBOL_FIELDS, SYMBOL_QUERY)}, {_sql_bm25("b", "s", "id", search.SYMBOL_FIELDS, _MORE)},
ra AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM a QUALIFY r <= 60), rb AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM b QUALIFY r <= 60),
x AS (SELECT id, 1.0 / (60 + r) + CASE WHEN r = 1 THEN 0.05 WHEN r <= 3 THEN 0.02 ELSE 0 END AS x FROM ra UNION ALL SELECT id, 0.5 / (60 + r) FROM rb)
SELECT id, round(sum(x), 6) AS score FROM x GROUP BY 1 ORDER BY sum(x) DESC, 1 LIMIT 20""",
    "expand_terms": """SELECT * FROM (VALUES ('auth cfg', 0, 'auth cfg'), ('auth cfg', 1, 'authentication'), ('auth cfg', 2, 'configuration'),
('removeUser', 0, 'removeUser'), ('removeUser', 1, 'remove'), ('removeUser', 2, 'delete'), ('removeUser', 3, 'destroy'), ('removeUser', 4, 'drop'), ('removeUser', 5, 'user'),
('load', 0, 'load'), ('load', 1, 'read'), ('load', 2, 'open'), ('load', 3, 'parse'), ('', 0, '')) v(query, place, term)""",
    "intents": f"""WITH {_ASKED}, w AS (SELECT query, contains(query, ' ') AS spaced, list_filter(string_split(lower(query), ' '), lambda x: x <> '') AS ws FROM q),
n AS (SELECT *, len(list_filter(ws, lambda x: list_contains([{", ".join(map(_quote, sorted(search.QUESTION_WORDS)))}], x))) AS asked FROM w),
c AS (SELECT query, 2 * CAST(contains(query, '_') AS INT) + 2 * CAST(contains(query, '.') AS INT) + 2 * CAST(contains(query, '::') AS INT) + 2 * CAST(regexp_matches(query, '[a-z][A-Z]') AS INT)
  + CAST(NOT spaced AND length(query) > 1 AND regexp_matches(query, '^[A-Z]') AND regexp_matches(query, '[a-z]') AS INT) + CAST(NOT spaced AS INT) AS y,
  CAST(spaced AS INT) + 2 * CAST(len(ws) > 3 AS INT) + CAST(asked >= 1 AS INT) + 2 * CAST(asked >= 2 AS INT) AS z FROM n)
SELECT query, CASE WHEN query = '' THEN 'hybrid' WHEN (y >= 2 AND z = 0) OR (y > z + 1 AND NOT (z >= 2 AND y = 0)) THEN 'symbol' WHEN (z >= 2 AND y = 0) OR z > y + 1 THEN 'semantic' ELSE 'hybrid' END AS intent FROM c""",
    "snippets": rf"""WITH {_S}, p AS (SELECT id, name, trim(string_split(doc_comment, chr(10))[1], ' ') AS d, trim(regexp_replace(signature, '[ \t\n\r\f\v]+', ' ', 'g'), ' ') AS g FROM s)
SELECT id, CASE WHEN d <> '' THEN d WHEN g <> '' THEN CASE WHEN length(g) > 120 THEN substr(g, 1, 120) || '...' ELSE g END ELSE name END AS snippet FROM p""",
    "identifier_words": r"""WITH n AS (SELECT DISTINCT name FROM nodes), w AS (SELECT unnest(string_split_regex(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')), '[^a-z0-9]+')) AS word FROM n)
SELECT word, count(*) AS n FROM w WHERE word <> '' GROUP BY 1""",
    "truncate_fit": f"""WITH b AS (SELECT id, any_value(body) AS body FROM nodes WHERE body IS NOT NULL GROUP BY 1), l AS (SELECT id AS key, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS p, unnest(string_split(body, chr(10))) AS line FROM b),
t AS (SELECT *, 1 + {_tokens_of("line")} AS tokens FROM l), u AS (SELECT *, sum(tokens) OVER (PARTITION BY key ORDER BY p ROWS UNBOUNDED PRECEDING) AS used FROM t)
SELECT key, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(length(line)) + count(*) - 1 AS INT) AS n_chars FROM u WHERE used <= 60 OR p = 1 GROUP BY 1""",
    "bm25_topk": f"WITH {_sql_bm25('a', 'documents', 'doc_id', _D, QUERY)} SELECT id, round(score, 6) AS score FROM a ORDER BY a.score DESC, id LIMIT 20",
    "keyword_symbols": f"WITH {_S}, {_sql_bm25('a', 's', 'id', search.SYMBOL_FIELDS, SYMBOL_QUERY)} SELECT id, round(score, 6) AS score FROM a ORDER BY a.score DESC, id LIMIT 20",
    "search_files": f"""WITH {_S}, {_sql_bm25('a', 's', 'id', search.SYMBOL_FIELDS, SYMBOL_QUERY)}, x AS (SELECT a.*, s.name, s.file_path, row_number() OVER (PARTITION BY file_path ORDER BY score DESC, id) AS r FROM a JOIN s USING (id))
SELECT file_path, count(*) AS n_matches, string_agg(name, ',' ORDER BY r) FILTER (r <= 5) AS top_names, round(sum(score), 6) AS total FROM x GROUP BY 1 ORDER BY sum(score) DESC, 1 LIMIT 20""",
    "workspace_search": f"""WITH {_S}, {_sql_bm25('a', 's', 'id', search.SYMBOL_FIELDS, SYMBOL_QUERY)}, x AS (SELECT a.*, string_split(file_path, '/')[1] AS repo FROM a JOIN s USING (id)),
t AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY score DESC, id) AS r FROM x QUALIFY r <= 3), m AS (SELECT repo, CAST(row_number() OVER (ORDER BY score DESC, repo) AS INT) AS repo_rank FROM t WHERE r = 1)
SELECT repo, repo_rank, id, round(score, 6) AS score FROM t JOIN m USING (repo)""",
    "knn_cosine": """WITH x AS (SELECT q.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS s FROM embeddings q JOIN embeddings b ON b.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS INT) AS rank, round(s, 5) AS similarity FROM x QUALIFY rank <= 10""",
    "rrf_fusion": _RRF + " SELECT id, round(sum(x), 6) AS score FROM (SELECT id, 1.0 / (60 + ra.r) + coalesce(x, 0) AS x FROM ra LEFT JOIN bonus USING (r) UNION ALL SELECT id, 1.0 / (60 + rb.r) + coalesce(x, 0) FROM rb LEFT JOIN bonus USING (r)) GROUP BY 1",
    "rrf_weighted": _RRF + " SELECT id, round(sum(x), 6) AS score FROM (SELECT id, 0.8 / (60 + ra.r) + coalesce(x, 0) AS x FROM ra LEFT JOIN bonus USING (r) UNION ALL SELECT id, 0.2 / (60 + rb.r) + coalesce(x, 0) FROM rb LEFT JOIN bonus USING (r) UNION ALL SELECT id, 0.4 / (60 + rb.r) FROM rb) GROUP BY 1",
    "token_estimate": f"SELECT doc_id, coalesce({_TOKENS}, 0) AS tokens FROM documents",
    "pack_budget": f"""WITH d AS (SELECT DISTINCT doc_id, coalesce(lower(trim(source, ' ')), '') AS source, coalesce({_TOKENS}, 0) AS tokens FROM documents),
u AS (SELECT *, row_number() OVER w AS r, CAST(sum(greatest(tokens, 1)) OVER w AS BIGINT) AS used FROM d WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)) SELECT source, doc_id, used FROM u WHERE used <= 500 OR r = 1""",
    "rule_findings": _HITS + " SELECT key, line_no, column_no, rule_id, matched_text FROM f",
    "owasp_findings": f"WITH {_BF}, {_OWASP_RULES}, "
    + _WHOLE.format(only=" AND (languages = '' OR list_contains(string_split(languages, ','), language))")
    + f" SELECT owasp, cwe, r.severity, count(*) AS n FROM f JOIN r USING (rule_id) WHERE NOT regexp_matches(lower(file_path), {_quote(_NO_TEST)}) GROUP BY 1, 2, 3",
    "scan_summary": _HITS + f", c AS (SELECT count(*) AS total, {_COUNTS} FROM f) SELECT *, {_RISK} FROM c",
    "finding_summary": f"WITH c AS (SELECT count(*) AS total, {_COUNTS} FROM (SELECT DISTINCT * FROM security_findings)) SELECT *, {_RISK} FROM c",
    "top_rules": _HITS + " SELECT rule_id, count(*) AS n FROM f GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "redact_secrets": f"SELECT finding_id, {_sql_redact('matched_text')} AS masked FROM (SELECT DISTINCT finding_id, matched_text FROM security_findings)",
    "taint_sources": _sql_patterns(security.SOURCES),
    "taint_sinks": _sql_patterns(security.SINKS),
    "signatures": """WITH b AS (SELECT id, any_value(body) AS body FROM nodes WHERE body IS NOT NULL GROUP BY 1)
SELECT id, trim(regexp_replace(CASE WHEN contains(body, '{') THEN string_split(body, '{')[1] WHEN contains(body, '=>') THEN string_split(body, '=>')[1] || '=>' ELSE string_split(body, chr(10))[1] END, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS signature FROM b""",
}
ORACLES["bm25_postings"] = ORACLES["bm25_topk"]
