"""Queries over small written inputs (sources, logs, manifests), whose results stand here as literal rows.

What SQL can't do by itself (extraction, parsing of git's output) is held against rows that were written by hand; queries of
JSON columns and evaluation run over the whole tables and have real twins.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.operators import evaluate, extract, reports, store
from orrery.plans import graph_queries
from orrery.sources import history, rows, tree
from orrery.sources.tables import table

SOURCES = {
    "app/main.py": 'import os\nfrom .store import load\n\n\nclass App(Base):\n    """Runs it."""\n\n    def run(self, conf: Conf) -> int:\n        return load(conf)\n\n\ndef start():\n    App().run(1)\n',
    "app/store.py": "class Conf:\n    pass\n\n\ndef load(c):\n    return c\n",
    "app/broken.py": "def fine():\n    return 1\n\n\ndef bad(:\n    pass\n",
    "web/view.ts": "import { load } from './data';\nexport class View extends Base {\n  draw(c: Model): void {\n    new Model();\n    load(c);\n  }\n}\n",
    "web/data.ts": "export class Model {}\nexport function load(x) {\n  return x;\n}\n",
    "srv/shop.rb": "require 'json'\nclass Cart < Base\n  def add(x)\n    check(x)\n  end\nend\n",
    "srv/main.c": "#include <stdio.h>\nint run(int a) {\n  return step(a);\n}\n",
    "srv/Job.java": "import a.B;\npublic class Job extends Base implements Runner {\n  public int go(Conf c) {\n    return work(c);\n  }\n}\n",
}
LOG = "\x1ec1\x1fAda\x1fada@x.example\x1f2025-03-01T10:00:00+00:00\x1ffix | parse\n3\t1\ta.py\n-\t-\tlogo.png\n\n\x1ec0\x1fBob\x1fbob@x.example\x1f2025-02-01T09:00:00+01:00\x1fstart\n10\t0\ta.py\n5\t0\tb.py\n"
_C1, _C0 = "a" * 40, "b" * 40
BLAME = f"{_C1} 1 1 1\nauthor Ada\nauthor-mail <ada@x.example>\nauthor-time 1740823200\nsummary x\nfilename a.py\n\tx = 1\n{_C0} 2 2 1\nauthor Bob\nauthor-mail <bob@x.example>\nauthor-time 1738396800\nfilename a.py\n\ty = 2\n{_C1} 3 3 1\n\tz = 3\n"
STATUS = "M  staged.py\n M changed.py\nMM both.py\n?? new.py\n"
MANIFESTS = {"package.json": '{"dependencies": {"express": "^4.18.2", "react": "18.2.0"}}', "requirements.txt": "django==4.2.1\nflask>=2.0\n", "go.mod": "require github.com/gin-gonic/gin v1.9.1\n"}


def _files(spark):
    return spark.createDataFrame([(p, tree.LANGUAGE_OF[p.rsplit(".", 1)[1]], t) for p, t in SOURCES.items()], "file_path string, language string, content string")


def extracted_symbols(spark, folder):
    return extract.nodes_of(extract.extract(_files(spark))).select("file_path", "type", "name", "start_line", "end_line", "qualified_name", "exported")


def extracted_references(spark, folder):
    found = extract.extract(_files(spark))
    return extract.reference_edges(found, extract.nodes_of(found))


def parsed_log(spark, folder):
    return history.parse_log(history.log_records(spark, LOG)).select("commit", "author", "email", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"), "subject", "file_path", "added", "deleted")


def parsed_blame(spark, folder):
    return history.parse_blame(history.text_rows(spark, BLAME))


def parsed_status(spark, folder):
    return history.parse_status(history.text_rows(spark, STATUS))


def log_hotspots(spark, folder):
    return history.hotspots(history.parse_log(history.log_records(spark, LOG))).select("file_path", "commits", "score")


def log_contributors(spark, folder):
    return history.contributors(history.parse_log(history.log_records(spark, LOG)))


def frameworks(spark, folder):
    return tree.detect_frameworks(spark.createDataFrame(list(MANIFESTS.items()), "path string, content string"))


def decoded_nodes(spark, folder):
    """What the metadata of the symbols says, against their columns."""
    n = rows.decode_nodes(table(spark, folder, "nodes"))
    return n.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("meta_exported")).alias("n_exported"), F.count_if(F.col("meta_start_column") == F.col("start_column")).alias("same_column"), F.sum("meta_end_column").alias("end_columns"))


def decoded_edges(spark, folder):
    e = rows.decode_edges(table(spark, folder, "edges"))
    return e.groupBy("type").agg(F.count("file_path").alias("with_path"), F.sum("line").cast("long").alias("lines"), F.count("property_map").alias("with_properties"))


def not_exported(spark, folder):
    return rows.not_exported(table(spark, folder, "nodes")).select("id").distinct()


def node_metadata(spark, folder):
    """The metadata written anew and read again: what comes back for each symbol."""
    s = table(spark, folder, "nodes").select("id", "start_column", "end_column", "body", "exported").distinct()
    back = rows.node_meta_json(s).select("id", F.from_json("metadata", "startColumn int, endColumn int, exported boolean, body string").alias("m"))
    return back.select("id", F.col("m.startColumn").alias("start_column"), F.col("m.endColumn").alias("end_column"), F.col("m.exported").alias("exported"), F.coalesce(F.length("m.body"), F.lit(0)).alias("body_chars")).distinct()


def unresolved_refs_count(spark, folder):
    return store.count_unresolved(store.unresolved_of(table(spark, folder, "unresolved_refs")))


def unresolved_cleared(spark, folder):
    """Unresolved references but those of the files that are listed with a hash, per repository."""
    refs = table(spark, folder, "unresolved_refs").distinct()
    left = store.clear_unresolved(refs, table(spark, folder, "file_listing").where("content_hash is not null"))
    return left.groupBy(F.element_at(F.split("file_path", "/"), 1).alias("repo")).agg(F.count(F.lit(1)).alias("n"))


def _names(nodes):
    return nodes.select("id", "name", "file_path").distinct()


def eval_callers(spark, folder):
    """Callers against what refers to the same names by edges of the type references."""
    nodes, edges = table(spark, folder, "nodes"), table(spark, folder, "edges")
    expected = evaluate.found_callers(nodes, edges.where("type = 'references'").withColumn("type", F.lit("calls")), nodes.select(F.col("name").alias("callee")))
    return _rounded(evaluate.eval_callers(nodes, edges, expected))


def eval_dead(spark, folder):
    """Symbols without an edge into them against those without a call."""
    nodes, edges = table(spark, folder, "nodes"), table(spark, folder, "edges")
    return _rounded(evaluate.eval_dead(nodes, edges, evaluate.found_dead(nodes, edges.where("type = 'calls'"))))


def eval_dependencies(spark, folder):
    """Files that import each other's symbols against files that call each other's."""
    nodes, edges = table(spark, folder, "nodes"), table(spark, folder, "edges")
    return _rounded(evaluate.eval_dependencies(nodes, edges, evaluate.found_dependencies(nodes, edges.where("type = 'calls'").withColumn("type", F.lit("imports")))))


def _rounded(df):
    return df.select(df.columns[0], *[F.round(c, 6).alias(c) for c in df.columns[1:]])


def structure(spark, folder):
    return reports.structure(table(spark, folder, "nodes"), table(spark, folder, "edges"), "harbor-mono/", 10)


def reference_scopes(spark, folder):
    """The function, method or class around each unresolved reference."""
    refs = table(spark, folder, "unresolved_refs").select("id", "file_path", F.col("line").alias("start_line")).distinct()
    return extract.enclosing_scope(refs, reports.symbols(table(spark, folder, "nodes"))).select("id", "start_line", "scope")


def qualified_names(spark, folder):
    """Methods and properties with the names of the containers around them, outermost first."""
    s = reports.symbols(table(spark, folder, "nodes"))
    return extract.qualified_names(s)


def _intervals(spark, folder):
    """Events as symbols of a file per user: purchases and signups are classes over the next events, the others methods."""
    e = table(spark, folder, "events").select("event_id", "user_id", "ts", "event_type")
    at = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    box = F.col("event_type").isin("purchase", "signup")
    return e.withColumn("start_line", at).select(
        F.col("event_id").cast("string").alias("id"), F.concat(F.lit("e"), F.col("event_id")).alias("name"), F.when(box, "class").otherwise("method").alias("type"),
        F.concat(F.lit("u"), F.col("user_id")).alias("file_path"), "start_line", F.when(box, F.col("start_line") + 4).otherwise(F.col("start_line")).alias("end_line"),
    )


def interval_containers(spark, folder):
    return extract.contains_edges(_intervals(spark, folder))


def interval_names(spark, folder):
    return extract.qualified_names(_intervals(spark, folder))


def react_components(spark, folder):
    s = reports.symbols(table(spark, folder, "nodes"))
    return extract.react_components(s)


_ALL = (extracted_symbols, extracted_references, parsed_log, parsed_blame, parsed_status, log_hotspots, log_contributors, frameworks, decoded_nodes, decoded_edges, not_exported, node_metadata, unresolved_refs_count, unresolved_cleared, eval_callers, eval_dead, eval_dependencies, structure, reference_scopes, qualified_names, interval_containers, interval_names, react_components)
QUERIES = {f.__name__: f for f in _ALL}

_LINKS = "n AS (SELECT DISTINCT id, name FROM nodes), p AS (SELECT DISTINCT id, file_path FROM nodes)"
_PRF = "round({h} / greatest({f}, 1), 6) AS precision, round({h} / greatest({e}, 1), 6) AS recall, round(CASE WHEN {h} > 0 THEN 2.0 * {h} / ({f} + {e}) ELSE 0 END, 6) AS f1"


def _prf(key: str, item: str) -> str:
    """The measures of the relations f and e."""
    count = "CAST(count(f.{i}) FILTER (e.{i} IS NOT NULL) AS DOUBLE)".format(i=item)
    joined = f"f FULL JOIN e ON f.{key} = e.{key} AND f.{item} = e.{item}"
    return f"SELECT coalesce(f.{key}, e.{key}) AS {key}, {_PRF.format(h=count, f=f'count(f.{item})', e=f'count(e.{item})')} FROM {joined} GROUP BY 1"


def _callers(kind: str) -> str:
    return f"SELECT DISTINCT t.name AS callee, s.name AS caller FROM edges JOIN n t ON t.id = target_id JOIN n s ON s.id = source_id WHERE type = '{kind}'"


def _deps(kind: str) -> str:
    return f"SELECT DISTINCT s.file_path AS file, t.file_path AS dependency FROM edges JOIN p s ON s.id = source_id JOIN p t ON t.id = target_id WHERE type = '{kind}' AND s.file_path <> t.file_path"


_DEAD = "SELECT DISTINCT 'dead' AS key, name FROM nodes WHERE type NOT IN ('module', 'namespace') AND file_path NOT ILIKE '%index.ts' AND id NOT IN (SELECT target_id FROM edges WHERE target_id IS NOT NULL{only})"
_LOOSE = "CASE lower(trim(type)) WHEN 'field' THEN 'property' WHEN 'package' THEN 'namespace' WHEN 'const' THEN 'constant' ELSE lower(trim(type)) END"

ORACLES = {
    "extracted_symbols": """SELECT file_path, type, name, CAST(s AS INT) AS start_line, CAST(e AS INT) AS end_line, qualified_name, exported FROM (VALUES
('app/main.py', 'class', 'App', 5, 9, NULL, true), ('app/main.py', 'method', 'run', 8, 9, 'App.run', true), ('app/main.py', 'function', 'start', 12, 13, NULL, true),
('app/store.py', 'class', 'Conf', 1, 2, NULL, true), ('app/store.py', 'function', 'load', 5, 6, NULL, true),
('app/broken.py', 'function', 'fine', 1, 2, NULL, true), ('app/broken.py', 'function', 'bad', 5, 6, NULL, true),
('web/view.ts', 'class', 'View', 2, 7, NULL, true), ('web/view.ts', 'method', 'draw', 3, 6, 'View.draw', false), ('web/data.ts', 'class', 'Model', 1, 1, NULL, true), ('web/data.ts', 'function', 'load', 2, 4, NULL, true),
('srv/shop.rb', 'class', 'Cart', 2, 6, NULL, true), ('srv/shop.rb', 'method', 'add', 3, 5, 'Cart.add', true), ('srv/main.c', 'function', 'run', 2, 4, NULL, true),
('srv/Job.java', 'class', 'Job', 2, 6, NULL, true), ('srv/Job.java', 'method', 'go', 3, 5, 'Job.go', true)) v(file_path, type, name, s, e, qualified_name, exported)""",
    "extracted_references": """SELECT * FROM (VALUES
('file:app/main.py', 'module:os', 'imports'), ('file:app/main.py', 'module:./store', 'imports'), ('class:app/main.py:App:5', 'unresolved:Base', 'extends'), ('method:app/main.py:run:8', 'class:app/store.py:Conf:1', 'references'),
('method:app/main.py:run:8', 'function:app/store.py:load:5', 'calls'), ('function:app/main.py:start:12', 'class:app/main.py:App:5', 'calls'), ('function:app/main.py:start:12', 'method:app/main.py:run:8', 'calls'), ('class:app/main.py:App:5', 'method:app/main.py:run:8', 'contains'),
('file:web/view.ts', 'module:./data', 'imports'), ('class:web/view.ts:View:2', 'unresolved:Base', 'extends'), ('method:web/view.ts:draw:3', 'class:web/data.ts:Model:1', 'references'), ('method:web/view.ts:draw:3', 'class:web/data.ts:Model:1', 'calls'),
('method:web/view.ts:draw:3', 'function:app/store.py:load:5', 'calls'), ('class:web/view.ts:View:2', 'method:web/view.ts:draw:3', 'contains'),
('file:srv/shop.rb', 'module:json', 'imports'), ('class:srv/shop.rb:Cart:2', 'unresolved:Base', 'extends'), ('method:srv/shop.rb:add:3', 'unresolved:check', 'calls'), ('class:srv/shop.rb:Cart:2', 'method:srv/shop.rb:add:3', 'contains'),
('file:srv/main.c', 'module:stdio.h', 'imports'), ('function:srv/main.c:run:2', 'unresolved:step', 'calls'),
('file:srv/Job.java', 'module:a.B', 'imports'), ('class:srv/Job.java:Job:2', 'unresolved:Base', 'extends'), ('class:srv/Job.java:Job:2', 'unresolved:Runner', 'implements'), ('method:srv/Job.java:go:3', 'class:app/store.py:Conf:1', 'references'),
('method:srv/Job.java:go:3', 'unresolved:work', 'calls'), ('class:srv/Job.java:Job:2', 'method:srv/Job.java:go:3', 'contains')) v(source_id, target_id, type)""",
    "parsed_log": """SELECT c AS "commit", author, email, d AS date, subject, file_path, CAST(a AS INT) AS added, CAST(x AS INT) AS deleted FROM (VALUES ('c1', 'Ada', 'ada@x.example', '2025-03-01 10:00:00', 'fix | parse', 'a.py', 3, 1), ('c1', 'Ada', 'ada@x.example', '2025-03-01 10:00:00', 'fix | parse', 'logo.png', 0, 0),
('c0', 'Bob', 'bob@x.example', '2025-02-01 08:00:00', 'start', 'a.py', 10, 0), ('c0', 'Bob', 'bob@x.example', '2025-02-01 08:00:00', 'start', 'b.py', 5, 0)) v(c, author, email, d, subject, file_path, a, x)""",
    "parsed_blame": f"""SELECT CAST(l AS INT) AS line_no, c AS "commit", author, email, d AS date, content FROM (VALUES (1, '{_C1}', 'Ada', 'ada@x.example', '2025-03-01 10:00:00', 'x = 1'), (2, '{_C0}', 'Bob', 'bob@x.example', '2025-02-01 08:00:00', 'y = 2'), (3, '{_C1}', 'Ada', 'ada@x.example', '2025-03-01 10:00:00', 'z = 3')) v(l, c, author, email, d, content)""",
    "parsed_status": "SELECT * FROM (VALUES ('staged.py', 'staged'), ('changed.py', 'unstaged'), ('both.py', 'staged'), ('both.py', 'unstaged'), ('new.py', 'untracked')) v(file_path, state)",
    "log_hotspots": "SELECT f AS file_path, CAST(n AS BIGINT) AS commits, CAST(s AS DOUBLE) AS score FROM (VALUES ('a.py', 2, 1.0), ('b.py', 1, 0.5), ('logo.png', 1, 0.5)) v(f, n, s)",
    "log_contributors": "SELECT e AS email, a AS author, CAST(n AS BIGINT) AS commits, CAST(p AS BIGINT) AS added, CAST(d AS BIGINT) AS deleted FROM (VALUES ('ada@x.example', 'Ada', 1, 3, 1), ('bob@x.example', 'Bob', 1, 15, 0)) v(e, a, n, p, d)",
    "frameworks": "SELECT * FROM (VALUES ('express', 'backend', 'package.json', '4.18.2'), ('react', 'frontend', 'package.json', '18.2.0'), ('django', 'backend', 'requirements.txt', '4.2.1'), ('flask', 'backend', 'requirements.txt', '2.0'), ('gin-gonic/gin', 'backend', 'go.mod', '1.9.1')) v(name, category, manifest, version)",
    "decoded_nodes": f"""WITH m AS (SELECT {_LOOSE} AS kind, start_column, CASE WHEN json_valid(metadata) THEN CAST(metadata AS JSON) END AS j FROM nodes)
SELECT kind, count(*) AS n, count(*) FILTER (json_extract_string(j, '$.exported') = 'true') AS n_exported, count(*) FILTER (CAST(json_extract_string(j, '$.startColumn') AS INT) = start_column) AS same_column, CAST(sum(CAST(json_extract_string(j, '$.endColumn') AS INT)) AS BIGINT) AS end_columns FROM m GROUP BY 1""",
    "decoded_edges": """WITH m AS (SELECT type, CASE WHEN json_valid(properties) THEN CAST(properties AS JSON) END AS j FROM edges)
SELECT type, count(json_extract_string(j, '$.filePath')) AS with_path, CAST(sum(coalesce(TRY_CAST(json_extract_string(j, '$.line') AS INT), 0)) AS BIGINT) AS lines, count(*) FILTER (len(json_keys(j)) > 0) AS with_properties FROM m GROUP BY 1""",
    "not_exported": "SELECT DISTINCT id FROM nodes WHERE NOT coalesce(CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.exported') END = 'true', false)",
    "node_metadata": "SELECT DISTINCT id, start_column, end_column, exported, CAST(least(coalesce(length(body), 0), 4096) AS INT) AS body_chars FROM nodes",
    "unresolved_refs_count": "SELECT count(*) AS n FROM (SELECT DISTINCT * FROM unresolved_refs)",
    "unresolved_cleared": "SELECT string_split(file_path, '/')[1] AS repo, count(*) AS n FROM (SELECT DISTINCT * FROM unresolved_refs) WHERE file_path NOT IN (SELECT file_path FROM file_listing WHERE content_hash IS NOT NULL) GROUP BY 1",
    "eval_callers": f"WITH {_LINKS}, f0 AS ({_callers('calls')}), e AS ({_callers('references')}), f AS (SELECT * FROM f0 WHERE callee IN (SELECT callee FROM e)) " + _prf("callee", "caller"),
    "eval_dead": f"WITH f AS ({_DEAD.format(only='')}), e AS ({_DEAD.format(only=chr(32) + 'AND type = ' + chr(39) + 'calls' + chr(39))}) " + _prf("key", "name"),
    "eval_dependencies": f"WITH {_LINKS}, f0 AS ({_deps('imports')}), e AS ({_deps('calls')}), f AS (SELECT * FROM f0 WHERE file IN (SELECT file FROM e)) " + _prf("file", "dependency"),
    "react_components": """WITH s AS (SELECT id, type, name, file_path, start_line FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC, deleted_at DESC NULLS LAST) AS rn FROM nodes)
  WHERE rn = 1 AND type IN ('function', 'class', 'variable') AND lower(language) IN ('tsx', 'jsx', 'typescript', 'javascript') AND regexp_matches(name, '^[A-Z]') AND regexp_matches(name, '[a-z]') AND NOT regexp_matches(name, '[_-]')),
o AS (SELECT name, file_path, arg_min(id, (start_line, id)) AS own FROM s GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY file_path) AS r FROM o),
t AS (SELECT a.name, a.file_path AS f1, a.own AS one, b.own AS two FROM k a JOIN k b ON a.name = b.name AND a.r = 1 AND b.r = 2)
SELECT s.id AS source_id, CASE WHEN s.file_path = t.f1 THEN t.two ELSE t.one END AS target_id, 'references' AS type FROM s JOIN t USING (name)""",
}

_SYMBOLS = "s AS (SELECT id, type, name, file_path, start_line, end_line FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC, deleted_at DESC NULLS LAST) AS rn FROM nodes) WHERE rn = 1)"
_BOXES = "('class', 'interface', 'struct', 'trait', 'enum')"
ORACLES |= {
    "structure": f"""WITH {_SYMBOLS}, h AS (SELECT * FROM s WHERE starts_with(file_path, 'harbor-mono/')), r AS ({graph_queries.ORACLES["pagerank_20"]})
SELECT 'kind' AS section, type AS name, CAST(count(*) AS DOUBLE) AS value FROM h GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'directory', regexp_replace(file_path, '/?[^/]*$', '') AS d, CAST(count(DISTINCT file_path) AS DOUBLE) AS n FROM h GROUP BY 2 ORDER BY n DESC, d LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'rank', id, rank FROM r WHERE id IN (SELECT id FROM nodes WHERE starts_with(file_path, 'harbor-mono/')) ORDER BY rank DESC, id LIMIT 10)""",
    "reference_scopes": f"""WITH {_SYMBOLS}, q AS (SELECT DISTINCT id, file_path, line FROM unresolved_refs),
m AS (SELECT q.id, q.file_path, q.line, s.id AS scope, row_number() OVER (PARTITION BY q.id, q.file_path, q.line ORDER BY s.end_line - s.start_line, s.start_line, s.id) AS r
  FROM q LEFT JOIN s ON s.file_path = q.file_path AND s.type IN ('function', 'method', 'class') AND s.start_line <= q.line AND q.line <= s.end_line)
SELECT id, line AS start_line, coalesce(scope, 'file:' || file_path) AS scope FROM m WHERE r = 1""",
    "qualified_names": f"""WITH {_SYMBOLS} SELECT m.id, string_agg(c.name, '.' ORDER BY c.end_line - c.start_line DESC, c.name DESC) || '.' || any_value(m.name) AS qualified_name
FROM s m JOIN s c ON c.file_path = m.file_path AND c.type IN {_BOXES} AND c.start_line <= m.start_line AND m.end_line <= c.end_line AND c.id <> m.id WHERE m.type IN ('method', 'property') GROUP BY 1""",
}

_INTERVALS = """i AS (SELECT CAST(event_id AS VARCHAR) AS id, 'e' || event_id AS name, event_type IN ('purchase', 'signup') AS box, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM events),
j AS (SELECT *, CASE WHEN box THEN s + 4 ELSE s END AS e FROM i), p AS (SELECT m.id, m.name, c.id AS cid, c.name AS cname, c.s, c.e FROM j m JOIN j c ON c.user_id = m.user_id AND c.box AND NOT m.box AND c.s <= m.s AND m.e <= c.e)"""
ORACLES |= {
    "interval_containers": f"WITH {_INTERVALS} SELECT arg_max(cid, (s, cid)) AS source_id, id AS target_id FROM p GROUP BY id",
    "interval_names": f"WITH {_INTERVALS} SELECT id, string_agg(cname, '.' ORDER BY e - s DESC, cname DESC) || '.' || any_value(name) AS qualified_name FROM p GROUP BY id",
}
