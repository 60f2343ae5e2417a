"""Relational reports over the code graph: one aggregate, join or window each, left to Catalyst.

`nodes` may hold several rows of an id (seen again); `symbols` keeps the latest of each. Deleted symbols are those whose
latest row has a deletion time; reports are over what is there, or over all, as their docstrings say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_KEEP = ("type", "name", "qualified_name", "file_path", "start_line", "end_line", "language", "signature", "doc_comment", "is_test", "exported", "deleted_at")


def symbols(nodes: DataFrame) -> DataFrame:
    """The latest row of each id; languages in lower case. One max over a struct, so copies are combined before the shuffle."""
    kept = [c for c in _KEEP if c in nodes.columns]
    top = F.max(F.struct("indexed_at", F.coalesce("deleted_at", F.lit(None)).alias("d"), *[F.col(c) for c in kept])).alias("top")
    out = nodes.where("id is not null").groupBy("id").agg(top).select("id", *[f"top.{c}" for c in kept])
    return out.withColumn("language", F.lower("language"))


def stats(nodes: DataFrame, edges: DataFrame, unresolved: DataFrame) -> DataFrame:
    """One row: n_nodes, n_edges, n_files, n_unresolved, over distinct ids."""
    a = nodes.agg(F.countDistinct("id").alias("n_nodes"), F.countDistinct("file_path").alias("n_files"))
    b = edges.agg(F.countDistinct("id").alias("n_edges"))
    c = unresolved.agg(F.countDistinct("id").alias("n_unresolved"))
    return a.crossJoin(b).crossJoin(c)  # one row each


def languages(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(language, n_files, n_symbols, n_out_edges, share): per language, share of the symbols in percent."""
    s = symbols(nodes).select("id", "language", "file_path")
    out = edges.groupBy(F.col("source_id").alias("id")).agg(F.countDistinct("id").alias("n"))
    per = s.join(out, "id", "left").groupBy("language").agg(F.countDistinct("file_path").alias("n_files"), F.count(F.lit(1)).alias("n_symbols"), F.sum(F.coalesce("n", F.lit(0))).alias("n_out_edges"))
    return per.withColumn("share", F.round(100.0 * F.col("n_symbols") / F.sum("n_symbols").over(W.partitionBy()), 1))  # one row per language


def languages_by_files(hashes: DataFrame) -> DataFrame:
    """(language, n) of the rows written for files, null as `unknown`."""
    return hashes.groupBy(F.coalesce(F.lower("language"), F.lit("unknown")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


def kinds(nodes: DataFrame, prefix: str = "") -> DataFrame:
    """(type, n) of the symbols below a path."""
    return symbols(nodes).where(F.col("file_path").startswith(prefix)).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def directory_of(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def project_tree(nodes: DataFrame, max_depth: int = 3) -> DataFrame:
    """(directory, n_files, n_symbols) of the directories that hold symbols, up to a depth."""
    d = directory_of(F.col("file_path"))
    s = symbols(nodes).withColumn("directory", F.when(d == "", ".").otherwise(d))
    depth = F.length("directory") - F.length(F.replace(F.col("directory"), F.lit("/")))
    return s.where(depth < max_depth).groupBy("directory").agg(F.countDistinct("file_path").alias("n_files"), F.count(F.lit(1)).alias("n_symbols"))


def top_directories(nodes: DataFrame, n: int = 10) -> DataFrame:
    """The n directories with most files, ties by name."""
    return symbols(nodes).groupBy(directory_of(F.col("file_path")).alias("directory")).agg(F.countDistinct("file_path").alias("n_files")).orderBy(F.desc("n_files"), "directory").limit(n)


def structure(nodes: DataFrame, edges: DataFrame, prefix: str = "", n: int = 10, iterations: int = 20) -> DataFrame:
    """(section, name, value): symbols per kind, the n directories with most files, the n symbols of greatest rank below a path."""
    from orrery.operators.graph import pagerank

    here = nodes.where(F.col("file_path").startswith(prefix))
    by_kind = kinds(here).select(F.lit("kind").alias("section"), F.col("type").alias("name"), F.col("n").cast("double").alias("value"))
    by_directory = top_directories(here, n).select(F.lit("directory"), "directory", F.col("n_files").cast("double"))
    ranks = pagerank(edges, nodes, iterations).select("id", F.round("rank", 9).alias("rank")).join(here.select("id").distinct(), "id", "left_semi")
    return by_kind.union(by_directory).union(ranks.orderBy(F.desc("rank"), "id").limit(n).select(F.lit("rank"), "id", "rank"))


def export_map(nodes: DataFrame) -> DataFrame:
    """(file_path, names) of the exported symbols, by line."""
    s = symbols(nodes).where(F.coalesce("exported", F.lit(False)))
    return s.groupBy("file_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "name"))), lambda x: x["name"]), ",").alias("names"))


def file_symbols(nodes: DataFrame, path: str) -> DataFrame:
    return symbols(nodes).where(F.col("file_path") == path).select("id", "type", "name", "start_line", "end_line")


def find_references(nodes: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, other, type, direction): edges between the targets and other symbols, both ways."""
    ids = nodes.select("id").distinct()
    e = edges.select("source_id", "target_id", "type").distinct()
    t = targets.select("id").distinct()
    out = e.join(t.select(F.col("id").alias("source_id")), "source_id", "left_semi").select(F.col("source_id").alias("id"), F.col("target_id").alias("other"), "type", F.lit("outgoing").alias("direction"))
    into = e.join(t.select(F.col("id").alias("target_id")), "target_id", "left_semi").select(F.col("target_id").alias("id"), F.col("source_id").alias("other"), "type", F.lit("incoming").alias("direction"))
    return out.unionByName(into).join(ids.select(F.col("id").alias("other")), "other", "left_semi").select("id", "other", "type", "direction")


def module_graph(nodes: DataFrame, edges: DataFrame, types: list[str] | None = None, scope: str = "") -> DataFrame:
    """(from_file, to_file): distinct pairs of different files joined by an edge; `file:` ends count as their paths."""
    files = nodes.groupBy("id").agg(F.min("file_path").alias("file_path"))
    e = edges if types is None else edges.where(F.col("type").isin(*types))
    e = e.select("source_id", "target_id").distinct()
    side = lambda c, name: F.coalesce(F.when(F.col(c).startswith("file:"), F.expr(f"substring({c}, 6)")), F.col(name))
    both = (
        e.join(files.select(F.col("id").alias("source_id"), F.col("file_path").alias("sf")), "source_id", "left")
        .join(files.select(F.col("id").alias("target_id"), F.col("file_path").alias("tf")), "target_id", "left")
        .select(side("source_id", "sf").alias("from_file"), side("target_id", "tf").alias("to_file"))
    )
    return both.where("from_file is not null and to_file is not null and from_file <> to_file").where(F.col("from_file").startswith(scope) | F.col("to_file").startswith(scope)).distinct()


def import_graph(nodes: DataFrame, edges: DataFrame, scope: str = "") -> DataFrame:
    return module_graph(nodes, edges, ["imports"], scope)


def dead_code(nodes: DataFrame, edges: DataFrame, kinds_: list[str] | None = None, include_exported: bool = False) -> DataFrame:
    """(id, name, file_path, start_line): symbols without an edge in, not exported, not main, no test, no module or namespace."""
    s = symbols(nodes).where(~F.col("type").isin("module", "namespace") & (F.lower("name") != "main") & (F.coalesce("is_test", F.lit(0)) == 0))
    if not include_exported:
        s = s.where(~F.coalesce("exported", F.lit(False)))
    if kinds_:
        s = s.where(F.col("type").isin(*kinds_))
    for pattern in ("test%", "%.test.%", "%.spec.%", "%!_!_tests!_!_%"):
        s = s.where(~(F.col("name").ilike("test%") if pattern == "test%" else F.expr(f"file_path ilike '{pattern}' escape '!'")))
    return s.join(edges.select(F.col("target_id").alias("id")).where("id is not null").distinct(), "id", "left_anti").select("id", "name", "file_path", "start_line")


def top_nodes(nodes: DataFrame, edges: DataFrame, n: int = 200, kind: str | None = None, language: str | None = None) -> DataFrame:
    """(id, in_degree): the n symbols with most distinct edges in, ties by id."""
    s = symbols(nodes)
    if kind:
        s = s.where(F.col("type") == kind)
    if language:
        s = s.where(F.col("language") == language.lower())
    into = edges.select(F.col("target_id").alias("id"), "source_id", "type").distinct().groupBy("id").agg(F.count("source_id").alias("n"))
    return s.select("id").join(into, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("in_degree")).orderBy(F.desc("in_degree"), "id").limit(min(n, 1000))


def list_edges(edges: DataFrame, n: int = 500) -> DataFrame:
    return edges.select("source_id", "target_id", "type").distinct().orderBy("source_id", "target_id", "type").limit(min(n, 5000))


def resolve_symbol(nodes: DataFrame, symbol: str) -> DataFrame:
    """The symbol of that id, else the first of that name by file and line: at most one row."""
    s = symbols(nodes).where((F.col("id") == symbol) | (F.col("name") == symbol))
    return s.orderBy(F.desc(F.col("id") == symbol), "file_path", "start_line", "id").limit(1).select("id", "type", "name", "file_path", "start_line")


def suggest_symbols(nodes: DataFrame, part: str, n: int = 10) -> DataFrame:
    """Symbols whose name holds a text, without regard to case; `%` and `_` are plain."""
    return symbols(nodes).where(F.contains(F.lower("name"), F.lit(part.lower()))).orderBy("name", "id").limit(n).select("id", "name", "file_path")


def node_detail(nodes: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, type, name, file_path, n_in, n_out): records with the number of their distinct relations."""
    e = edges.select("source_id", "target_id", "type").distinct()
    s = symbols(nodes).join(targets.select("id").distinct(), "id", "left_semi")
    out = e.groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("n_out"))
    into = e.groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("n_in"))
    return s.join(out, "id", "left").join(into, "id", "left").select("id", "type", "name", "file_path", F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"))


def filter_symbols(nodes: DataFrame, language: str | None = None, kind: str | None = None, prefix: str | None = None) -> DataFrame:
    s = symbols(nodes)
    for c, v in (("language", language and language.lower()), ("type", kind)):
        if v:
            s = s.where(F.col(c) == v)
    return s.where(F.col("file_path").startswith(prefix)) if prefix else s


def longest_prefix(paths: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(path, description) of the longest configured prefix of each path: an equi-join on the path's own prefixes.

    `paths` has path, `prefixes` has prefix and description. A path offers each of its leading parts, so no prefix is
    compared with all paths.
    """
    parts = F.split("path", "/")
    own = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    tried = paths.select("path").distinct().select("path", F.explode(own).alias("prefix"))
    hit = tried.join(prefixes.select(F.regexp_replace("prefix", "/+$", "").alias("prefix"), "description"), "prefix")
    return hit.groupBy("path").agg(F.max_by("description", F.struct(F.length("prefix"), "description")).alias("description"))


#: A diagram with more edges than this can't be read; asking for one is an error.
MOST_DRAWN = 5000


def mermaid(edges: DataFrame, names: DataFrame, direction: str = "LR") -> str:
    """Text of a diagram of at most MOST_DRAWN edges. `names` has id and name; only those at an end of an edge are fetched.

    Ids become their hash in hex; ends without a name are left out.
    """
    drawn = edges.select("source_id", "target_id", "type").distinct()
    rows = sorted((r["source_id"], r["target_id"], r["type"]) for r in drawn.limit(MOST_DRAWN + 1).collect())
    if len(rows) > MOST_DRAWN:
        raise ValueError(f"more than {MOST_DRAWN} edges: draw a smaller neighborhood")
    ends = edges.sparkSession.createDataFrame([(x,) for x in sorted({x for s, t, _ in rows for x in (s, t)})] or [], "id string")
    named = {r["id"]: r["name"] for r in names.join(F.broadcast(ends), "id", "left_semi").groupBy("id").agg(F.max("name").alias("name")).collect()}
    lines = [f"graph {direction}"]
    lines += [f'    n{mermaid_id(i)}["{safe_label(named[i])}"]' for i in sorted(named)]
    lines += [f"    n{mermaid_id(s)} -->|{t}| n{mermaid_id(d)}" for s, d, t in rows if s in named and d in named]
    return "\n".join(lines)


def hash31(text: str) -> int:
    """h * 31 + code unit, as a signed 32-bit number."""
    h = 0
    data = text.encode("utf-16-le", "surrogatepass")
    for k in range(0, len(data), 2):
        h = (h * 31 + data[k] + 256 * data[k + 1]) & 0xFFFFFFFF
    return h - (1 << 32) if h >= 1 << 31 else h


def base36(n: int) -> str:
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"
    m, out = abs(n), ""
    while m:
        m, r = divmod(m, 36)
        out = digits[r] + out
    return ("-" if n < 0 else "") + (out or "0")


def source_hash(id_: Column) -> Column:
    """The hash of an id in base 36, JVM-side."""
    h = F.java_method(F.lit("java.util.Objects"), F.lit("hashCode"), id_).cast("long")
    return F.concat(F.when(h < 0, "-").otherwise(""), F.lower(F.conv(F.abs(h), 10, 36)))


def mermaid_id(text: str) -> str:
    return format(abs(hash31(text)), "x")


def safe_label(text: str) -> str:
    return "".join("_" if c in '"[](){}<>|`#' else c for c in text)
