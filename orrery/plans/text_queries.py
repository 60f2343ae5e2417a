"""Queries of the analyses of program text, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.operators import textflow
from orrery.sources.tables import table


def _bodies(spark, folder) -> DataFrame:
    """One body per id; bodies of an id are equal."""
    return table(spark, folder, "nodes").where("body is not null").groupBy("id").agg(F.first("body").alias("body"))


def lines(spark, folder):
    return textflow.lines(_bodies(spark, folder), "id", "body").groupBy("key").agg(F.count(F.lit(1)).alias("n_lines"), F.max(F.length("line")).alias("longest"))


def complexity(spark, folder):
    return textflow.complexity(_bodies(spark, folder), "id", "body")


def complexity_report(spark, folder):
    return textflow.complexity_report(_bodies(spark, folder), "id", "body")


def _events(spark, folder):
    """Events as a program: signups and purchases define the user's variable, the others use it; position is the line."""
    rows = table(spark, folder, "events").select("user_id", "ts", "event_id", "event_type")
    pos = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    e = rows.select(F.lit("events").alias("key"), F.concat(F.lit("v"), F.col("user_id")).alias("var"), pos.alias("line_no"), F.col("event_type").isin("signup", "purchase").alias("d"))
    return e.where("d").drop("d"), e.where("not d").drop("d")


def dead_stores(spark, folder):
    return textflow.dead_stores(*_events(spark, folder))


def uninitialized(spark, folder):
    return textflow.uninitialized(*_events(spark, folder))


def reaching_defs(spark, folder):
    return textflow.reaching(*_events(spark, folder), 5)


def def_use(spark, folder):
    return textflow.def_use(*_events(spark, folder))


def _program(spark, folder):
    rows = textflow.lines(_bodies(spark, folder), "id", "body")
    return textflow.definitions(rows), textflow.uses(rows)


def body_dead_stores(spark, folder):
    return textflow.dead_stores(*_program(spark, folder))


def body_definitions(spark, folder):
    return _program(spark, folder)[0].groupBy("key").agg(F.count(F.lit(1)).alias("n_defs"), F.countDistinct("var").alias("n_vars"))


QUERIES = {f.__name__: f for f in (lines, complexity, complexity_report, dead_stores, uninitialized, reaching_defs, def_use, body_dead_stores, body_definitions)}

_B = "b AS (SELECT id, any_value(body) AS body FROM nodes WHERE body IS NOT NULL GROUP BY 1), l AS (SELECT id AS key, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS line_no, rtrim(unnest(string_split(body, chr(10))), chr(13)) AS line FROM b)"


def _n(words: list[str]) -> str:
    return " + ".join(f"len(regexp_extract_all(replace(line, ' ', '  '), '(^|[^A-Za-z0-9_])({w.replace(' ', '[[:space:]]+')})([^A-Za-z0-9_]|$)'))" for w in words)


_E = """e AS (SELECT 'v' || user_id AS var, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line_no, event_type IN ('signup', 'purchase') AS d FROM events)"""

ORACLES = {
    "lines": f"WITH {_B} SELECT key, count(*) AS n_lines, max(length(line)) AS longest FROM l GROUP BY 1",
    "dead_stores": f"WITH {_E}, x AS (SELECT *, lead(d) OVER w AS nd, lead(line_no) OVER w AS nl FROM e WINDOW w AS (PARTITION BY var ORDER BY line_no)) SELECT 'events' AS key, var, CAST(line_no AS INT) AS line_no, CAST(nl AS INT) AS next_def FROM x WHERE d AND nd",
    "uninitialized": f"WITH {_E}, x AS (SELECT var, min(line_no) FILTER (d) AS dd, min(line_no) FILTER (NOT d) AS u FROM e GROUP BY 1) SELECT 'events' AS key, var, CAST(u AS INT) AS first_use FROM x WHERE u IS NOT NULL AND (u < dd OR dd IS NULL)",
    "reaching_defs": f"""WITH {_E} SELECT 'events' AS key, var, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS defs FROM e WHERE d AND line_no <= 5
AND var IN (SELECT var FROM e WHERE NOT d AND line_no BETWEEN 4 AND 6) GROUP BY var""",
    "def_use": f"WITH {_E} SELECT 'events' AS key, var, coalesce(string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) FILTER (d), '') AS defs, coalesce(string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) FILTER (NOT d), '') AS uses FROM e GROUP BY var",
}


def _words(words: list[str]) -> str:
    """Occurrences of whole words: the words of a line are cut out and compared, as RE2 has no lookahead."""
    single = [w for w in words if " " not in w]
    double = [w for w in words if " " in w]
    out = f"len(list_filter(ws, lambda x: x IN ({', '.join(repr(w) for w in single)})))"
    for w in double:
        a, b = w.split(" ")
        out += f" + len(regexp_extract_all(line, '\\b{a}\\s{b}\\b'))"
    return out


_W = _B + ", lw AS (SELECT key, line, string_split_regex(line, '[^A-Za-z0-9_]+') AS ws, length(line) - length(ltrim(line, ' ')) AS indent FROM l WHERE trim(line, ' ') <> '')"
_C = f"""WITH {_W}, m AS (SELECT *, least(floor((indent - min(indent) OVER (PARTITION BY key)) / 2), 10) AS level FROM lw),
c AS (SELECT key, {_words(textflow.BRANCHES)} AS b, len(regexp_extract_all(line, '&&|\\|\\|')) AS o, ({_words(textflow.NESTING)}) * (1 + level) AS n, {_words(textflow.FLAT)} AS f FROM m),
r AS (SELECT key, CAST(1 + sum(b + o) AS BIGINT) AS cyclomatic, CAST(sum(n + f + o) AS BIGINT) AS cognitive FROM c GROUP BY 1)"""
ORACLES["complexity"] = _C + " SELECT * FROM r"
ORACLES["complexity_report"] = _C + " SELECT * FROM r WHERE cyclomatic >= 5 ORDER BY cyclomatic DESC, key LIMIT 50"


_KW = ", ".join(f"'{w}'" for w in textflow.KEYWORDS)
_ID = "[A-Za-z_$][A-Za-z0-9_$]*"
_SET = rf"^((?:{'|'.join(textflow.DECLARE)})\s+)*({_ID})\s*(:\s*[A-Za-z0-9_<>\[\], ]+?)?\s*(:=|=)"
_STRINGS = r'"([^"\\]|\\.)*"|' + r"''([^''\\]|\\.)*''"
_TEXTUAL = rf"""{_B}, t AS (SELECT key, CAST(line_no AS INT) AS line_no, trim(line, ' ' || chr(9) || chr(13)) AS line FROM l), c AS (SELECT * FROM t WHERE NOT regexp_matches(line, '^(//|#|\*|/\*)')),
d AS (SELECT * FROM (SELECT key, line_no, regexp_extract(line || ' ', '{_SET}[^=>]', 2) AS var FROM c) WHERE var <> '' AND var NOT IN ({_KW})),
x AS (SELECT key, line_no, regexp_replace(regexp_replace(regexp_replace(line, '{_STRINGS}', '', 'g'), '//.*$|(\s)#.*$', '\1'), '{_SET}([^=>]|$)', '\5') AS bare FROM c),
u AS (SELECT DISTINCT key, line_no, var FROM (SELECT key, line_no, unnest(regexp_extract_all(' ' || bare, '[^A-Za-z0-9_$.]({_ID})', 1)) AS var FROM x) WHERE var NOT IN ({_KW}))"""
ORACLES["body_definitions"] = f"WITH {_TEXTUAL} SELECT key, count(*) AS n_defs, count(DISTINCT var) AS n_vars FROM d GROUP BY 1"
ORACLES["body_dead_stores"] = f"""WITH {_TEXTUAL}, e AS (SELECT DISTINCT key, var, line_no, 1 AS d FROM d UNION ALL SELECT key, var, line_no, 0 FROM u),
o AS (SELECT *, lead(d) OVER w AS nd, lead(line_no) OVER w AS nl FROM e WINDOW w AS (PARTITION BY key, var ORDER BY line_no, d)) SELECT key, var, line_no, nl AS next_def FROM o WHERE d = 1 AND nd = 1"""
