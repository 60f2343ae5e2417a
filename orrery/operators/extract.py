"""Extraction of definitions and raw references from sources, and their resolution by joins.

One pass over each file gives definitions and raw references at once, with the container of each definition and the scope
of each reference, as the whole file is at hand there. Python is read with its own parser, and by the lexer where a file
has syntax errors; the other languages by a lexer that knows their comments, literals and blocks (see `languages`).

Defined results: null and empty texts and unknown languages give no rows; a file whose braces don't close has its last
blocks end with the file.
"""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions.paths import directory, resolve_dots
from orrery.operators.languages import BUILTIN_TYPES, LANGUAGES, block_end, blank_out
from orrery.operators.orphans import SUFFIXES

MOST_BODY = 2000
# Which kind wins where two definitions share file, name and line.
SPECIFICITY = {"variable": 0, "type_alias": 1, "function": 2, "module": 2, "namespace": 2, "property": 2, "constant": 2, "class": 3, "struct": 3, "enum": 3, "method": 3, "interface": 4, "trait": 4}
_CONTAINERS = ("class", "interface", "struct", "trait", "enum")
_CALL = re.compile(r"(?<![\w.$])(new\s+)?(?:([A-Za-z_$][\w$]*)\.)?([A-Za-z_$][\w$]*)\s*\(")
_NO_CALL = set("if for while switch catch return function match fn func sizeof typeof super constructor elif except print def class await yield throw new in of and or not".split())


def _shorten(body: str) -> str:
    return body if len(body) <= MOST_BODY else body[:MOST_BODY] + "..."


Row = tuple  # record, kind, name, start_line, end_line, exported, doc, body, extra


def extract_file(path: str, language: str, text: str) -> list[tuple]:
    """Rows (record, kind, name, start_line, end_line, exported, doc, body, extra, outer, container, scope).

    record is `def` or `ref`; kinds of references are calls, imports, extends, implements and types; extra is the object,
    `new`, the child or the imported names (after `*` where they're exported again). outer has the names of the containers
    around a method, outermost first; container and scope are "kind:name:line" of the tightest one.
    """
    rows = _python(text) if language == "python" else None
    if rows is None:
        rows = _lexed(language, text)
    return _placed(rows)


def _lexed(language: str, text: str) -> list[Row]:
    known = LANGUAGES.get(language)
    if known is None or not text:
        return []
    code = blank_out(text, known)
    starts = [0] + [m.end() for m in re.finditer("\n", code)]
    line_of = lambda at: bisect.bisect_right(starts, at)
    found: dict[tuple[str, int], Row] = {}
    for kind, pattern in known.definitions:
        for m in re.finditer(pattern, code, re.M):
            name, at = m.group(1), m.start(1)
            if name in _NO_CALL:
                continue
            start = line_of(at)
            old = found.get((name, start))
            if old is not None and SPECIFICITY[kind] <= SPECIFICITY[old[1]]:
                continue
            end_at = max(at + 1, block_end(code, at, m.end(), known))
            head = code[starts[start - 1] : at]
            if known.exported:
                exported = bool(re.search(known.exported, code[starts[start - 1] : m.end(1)]))
            else:
                exported = not (known.private and re.search(known.private, head))
            found[name, start] = ("def", kind, name, start, line_of(end_at - 1), exported, _doc_before(text, starts, start), _shorten(text[starts[start - 1] : end_at]), None)
    out = list(found.values())
    for m in re.finditer(known.imports, text, re.M):
        groups = m.groupdict()
        source = next((groups[g] for g in "abc" if groups.get(g)), None)
        if source:
            names = groups.get("names") or groups.get("reexported")
            names = ",".join(x for x in re.findall(r"[\w$]+", re.sub(r"\bas\s+\w+", "", names)) if x != "type") if names else None
            if groups.get("reexported"):
                names = "*" + ("," + names if names else "")
            out.append(("ref", "imports", source, line_of(m.start()), line_of(m.start()), None, None, None, names))
    for m in _CALL.finditer(code):
        if m.group(3) not in _NO_CALL and (m.group(3), line_of(m.start(3))) not in found:
            out.append(("ref", "calls", m.group(3), line_of(m.start(3)), line_of(m.start(3)), None, None, None, "new" if m.group(1) else m.group(2)))
    for kind, pattern in known.inherits:
        for m in re.finditer(pattern, code, re.M):
            named = m.groupdict()
            child, parents = (named["child"], named["parent"]) if named else m.groups()
            for parent in re.findall(r"[A-Za-z_$][\w$]*", re.sub(r"<[^>]*>|\([^)]*\)|\w+[.:]+(?=\w)", "", parents)):
                if parent not in ("public", "private", "protected", "virtual", "with"):
                    out.append(("ref", kind, parent, line_of(m.start()), line_of(m.start()), None, None, None, child))
    if known.types:
        for m in re.finditer(known.types, code, re.M):
            name = next((g for g in m.groups() if g), None)
            if name and name not in BUILTIN_TYPES:
                out.append(("ref", "types", name, line_of(m.start()), line_of(m.start()), None, None, None, None))
    return out


def _placed(rows: list[Row]) -> list[tuple]:
    """The rows with outer, container and scope: one walk over the lines with a stack of the open definitions."""
    defs = sorted((r for r in rows if r[0] == "def"), key=lambda r: (r[3], -r[4]))
    refs = sorted((r for r in rows if r[0] == "ref"), key=lambda r: r[3])
    out: list[tuple] = []
    stack: list[Row] = []
    name_of = lambda r: f"{r[1]}:{r[2]}:{r[3]}"
    i = 0
    for r in refs + [None]:
        line = r[3] if r else float("inf")
        while i < len(defs) and defs[i][3] <= line:
            d = defs[i]
            i += 1
            stack = [x for x in stack if x[4] >= d[4] and x[3] <= d[3] and x is not d]
            boxes = [x for x in stack if x[1] in _CONTAINERS]
            inner = stack[-1] if stack else None
            if d[1] == "function" and inner is not None and inner[1] in _CONTAINERS and (inner[3], inner[2]) != (d[3], d[2]):
                d = (d[0], "method", *d[2:])
            member = d[1] in ("method", "property")
            outer = ".".join(x[2] for x in boxes) if member and boxes else None
            out.append((*d, outer, name_of(boxes[-1]) if d[1] == "method" and boxes else None, None))
            stack.append(d)
        if r:
            scope = next((x for x in reversed(stack) if x[3] <= line <= x[4] and x[1] in ("function", "method", "class")), None)
            out.append((*r, None, None, name_of(scope) if scope else None))
    return out


def _doc_before(text: str, starts: list[int], line: int) -> str | None:
    before = text[: starts[line - 1]].rstrip()
    if before.endswith("*/"):
        at = before.rfind("/*")
        return before[at:] if at >= 0 else None
    rows = before.split("\n")
    k = len(rows)
    while k and rows[k - 1].lstrip().startswith(("//", "#")):
        k -= 1
    return "\n".join(r.strip() for r in rows[k:]) or None


def clean_comment(text: str) -> str:
    """A comment without its signs and with trimmed lines; tags and text stay."""
    rows = re.sub(r"^\s*(?:/\*+!?|\"{3}|'{3}|<#|\(\*|\{-)|(?:\*+/|\"{3}|'{3}|#>|\*\)|-\})\s*$", "", text.strip()).split("\n")
    return "\n".join(re.sub(r"^\s*(?:///?!?|\*(?!\*)|#+(?!!)|--+|;+|%+)?\s?", "", r).rstrip() for r in rows).strip()


def strip_quotes(text: str) -> str:
    """Without one pair of quotes around it."""
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'`" else text


def _python(text: str) -> list[Row] | None:
    """None if the file can't be parsed as a whole."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    rows = text.split("\n")
    out: list[tuple] = []

    def visit(node: ast.AST, inside_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if inside_class else "function"
                body = "\n".join(rows[child.lineno - 1 : child.end_lineno])
                out.append(("def", kind, child.name, child.lineno, child.end_lineno, not child.name.startswith("_"), ast.get_docstring(child), _shorten(body), None))
                for base in getattr(child, "bases", []):
                    if isinstance(base, (ast.Name, ast.Attribute)):
                        out.append(("ref", "extends", base.id if isinstance(base, ast.Name) else base.attr, child.lineno, child.lineno, None, None, None, child.name))
                if not isinstance(child, ast.ClassDef):
                    notes = [a.annotation for a in [*child.args.posonlyargs, *child.args.args, *child.args.kwonlyargs] if a.annotation] + ([child.returns] if child.returns else [])
                    for name in {x.id for note in notes for x in ast.walk(note) if isinstance(x, ast.Name)} - BUILTIN_TYPES:
                        if name[:1].isupper():
                            out.append(("ref", "types", name, child.lineno, child.lineno, None, None, None, None))
                visit(child, isinstance(child, ast.ClassDef))
                continue
            if isinstance(child, ast.Assign) and isinstance(node, (ast.Module, ast.ClassDef)):
                for t in child.targets:
                    if isinstance(t, ast.Name):
                        out.append(("def", "variable", t.id, child.lineno, child.end_lineno, not t.id.startswith("_"), None, _shorten("\n".join(rows[child.lineno - 1 : child.end_lineno])), None))
            elif isinstance(child, ast.Import):
                out.extend(("ref", "imports", a.name, child.lineno, child.lineno, None, None, None, None) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                out.append(("ref", "imports", ("./" if child.level == 1 else "../" * max(0, child.level - 1)) + (child.module or "").replace(".", "/" if child.level else "."), child.lineno, child.lineno, None, None, None, ",".join(a.name for a in child.names)))
            elif isinstance(child, ast.Call):
                f = child.func
                if isinstance(f, ast.Name):
                    out.append(("ref", "calls", f.id, child.lineno, child.lineno, None, None, None, None))
                elif isinstance(f, ast.Attribute):
                    out.append(("ref", "calls", f.attr, child.lineno, child.lineno, None, None, None, f.value.id if isinstance(f.value, ast.Name) else None))
            visit(child, inside_class and not isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)))

    visit(tree, False)
    return out


_SCHEMA = "file_path string, language string, record string, kind string, name string, start_line int, end_line int, exported boolean, doc_comment string, body string, extra string, outer string, container string, scope string"


def extract(files: DataFrame) -> DataFrame:
    """Definitions and raw references of files (file_path, language, content), one pass per file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 5 + [pa.int32()] * 2 + [pa.bool_()] + [pa.string()] * 6
        names = [c.split()[0] for c in _SCHEMA.split(", ")]
        for b in batches:
            rows = [(p, lang, *r) for p, lang, t in zip(*(b.column(c).to_pylist() for c in ("file_path", "language", "content"))) for r in extract_file(p, (lang or "").lower(), t or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return files.select("file_path", "language", "content").mapInArrow(run, _SCHEMA)


def node_id(kind, path, name, line) -> Column:
    return F.concat_ws(":", kind, path, name, line)


def nodes_of(extracted: DataFrame) -> DataFrame:
    """Symbols with ids and qualified names: the names of all containers around a method or property, outermost first."""
    defs = extracted.where("record = 'def'").withColumn("id", node_id("kind", "file_path", "name", "start_line"))
    rank = F.row_number().over(W.partitionBy("file_path", "name", "start_line").orderBy(F.desc(F.create_map(*[F.lit(x) for kv in SPECIFICITY.items() for x in kv])[F.col("kind")]), "id"))
    defs = defs.withColumn("r", rank).where("r = 1").drop("r")
    qualified = F.when(F.col("outer").isNotNull(), F.concat("outer", F.lit("."), F.col("name")))
    return defs.select("id", F.col("kind").alias("type"), "name", qualified.alias("qualified_name"), "file_path", "start_line", "end_line", "language", "doc_comment", "body", "exported", is_test(F.col("name"), F.col("file_path"), F.col("language")).alias("is_test"))


def is_test(name: Column, path: Column, language: Column) -> Column:
    """1 for tests by name or path, per language."""
    low, p = F.lower(name), F.lower(path)
    by_path = p.rlike(r"(?:^|/)(?:tests?|__tests__|spec)/|[._](?:test|spec)\.[a-z]+$|(?:^|/)test_[^/]*\.py$|_test\.(?:go|py)$|tests?\.java$")
    by_name = F.when(language == "python", low.startswith("test_") | name.startswith("Test")).when(language == "go", name.rlike("^(?:Test|Benchmark|Example)[A-Z_]")).when(language == "java", low.startswith("test")).otherwise(low.rlike("^(?:test|it|describe)_"))
    return (by_path | by_name).cast("int")


def contains_edges(nodes: DataFrame) -> DataFrame:
    """(source_id, target_id): each method of a table of symbols in its tightest container, the one that begins last.

    The containers of a file travel as one array, so a large file makes no rows of containers x members.
    """
    box = nodes.where(F.col("type").isin(*_CONTAINERS)).groupBy("file_path").agg(F.collect_list(F.struct(F.col("start_line").alias("s"), F.col("id").alias("i"), F.col("end_line").alias("e"))).alias("boxes"))  # of one file
    inner = nodes.where("type = 'method'").select(F.col("id").alias("target_id"), "file_path", "start_line", "end_line")
    around = F.filter("boxes", lambda x: (x["s"] <= F.col("start_line")) & (F.col("end_line") <= x["e"]) & (x["i"] != F.col("target_id")))
    return inner.join(box, "file_path").select(F.array_max(around)["i"].alias("source_id"), "target_id").where("source_id is not null")


def qualified_names(nodes: DataFrame) -> DataFrame:
    """(id, qualified_name) of the methods and properties of a table of symbols that have a container: its and all outer names."""
    box = nodes.where(F.col("type").isin(*_CONTAINERS)).groupBy("file_path").agg(F.collect_list(F.struct((F.col("end_line") - F.col("start_line")).alias("n"), F.col("name").alias("c"), F.col("id").alias("i"), F.col("start_line").alias("s"), F.col("end_line").alias("e"))).alias("boxes"))  # of one file
    around = F.filter("boxes", lambda x: (x["s"] <= F.col("start_line")) & (F.col("end_line") <= x["e"]) & (x["i"] != F.col("id")))
    outer = F.transform(F.sort_array(around, asc=False), lambda x: x["c"])
    rows = nodes.where("type in ('method', 'property')").join(box, "file_path").withColumn("outer", outer).where(F.size("outer") > 0)
    return rows.select("id", F.concat_ws(".", F.array_join("outer", "."), "name").alias("qualified_name"))


def enclosing_scope(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """References of a table with `scope`: the smallest function, method or class around their line, else `file:` and the path."""
    scopes = nodes.where("type in ('function', 'method', 'class')").groupBy("file_path").agg(F.collect_list(F.struct((F.col("end_line") - F.col("start_line")).alias("n"), F.col("start_line").alias("s"), F.col("id").alias("i"), F.col("end_line").alias("e"))).alias("scopes"))  # of one file
    around = F.filter("scopes", lambda x: (x["s"] <= F.col("start_line")) & (F.col("start_line") <= x["e"]))
    return refs.drop("scope").join(scopes, "file_path", "left").withColumn("scope", F.coalesce(F.array_min(around)["i"], F.concat(F.lit("file:"), F.col("file_path")))).drop("scopes")


def resolve_names(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """References with `target_id`: of the symbols of that name the first in the same file, else the first exported, else the
    first, by file and line.

    Candidates are reduced to one row per name and file and one per name before they meet the references, so a name that
    very many symbols have is no product.
    """
    first = F.struct("file_path", "start_line", "id")
    same = nodes.groupBy("name", "file_path").agg(F.min(F.struct("start_line", "id")).alias("same"))
    any_ = nodes.groupBy("name").agg(F.min(F.when(F.coalesce("exported", F.lit(False)), first)).alias("out"), F.min(first).alias("first"))
    found = refs.join(same, ["name", "file_path"], "left").join(any_, "name", "left")
    target = F.coalesce(F.col("same.id"), F.col("out.id"), F.col("first.id"), F.concat(F.lit("unresolved:"), F.col("name")))
    return found.select(*refs.columns, target.alias("target_id"))


def _named(place: Column, path: Column) -> Column:
    """The id of "kind:name:line" in a file."""
    parts = F.split(place, ":")
    return node_id(parts[0], path, parts[1], parts[2])


def edges_of(extracted: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source_id, target_id, type, properties): calls, inheritance, imports, references to types, containment.

    properties is a JSON object with filePath and line, and where there is one the object, the names, or constructor. A
    reference to a type that no symbol answers is none.
    """
    refs = extracted.where("record = 'ref'").select("file_path", "kind", "name", "start_line", "extra", "scope").distinct()
    path = F.concat(F.lit("file:"), F.col("file_path"))
    source = F.coalesce(_named(F.col("scope"), F.col("file_path")), path)
    child = F.col("kind").isin("extends", "implements")
    of_child = nodes.where(F.col("type").isin(*_CONTAINERS)).groupBy("file_path", F.col("name").alias("extra")).agg(F.min(F.struct("start_line", "id")).alias("c")).select("file_path", "extra", F.col("c.id").alias("child_id"))
    named = resolve_names(refs.where("kind <> 'imports'"), nodes).join(of_child, ["file_path", "extra"], "left").where("kind <> 'types' or not startswith(target_id, 'unresolved:')")
    named = named.select(F.when(child, F.coalesce("child_id", source)).otherwise(source).alias("source_id"), "target_id", F.when(F.col("kind") == "types", "references").otherwise(F.col("kind")).alias("type"), "file_path", "start_line", F.when(child, F.lit(None)).otherwise(F.col("extra")).alias("extra"))
    imports = refs.where("kind = 'imports'").select(path.alias("source_id"), F.concat(F.lit("module:"), F.col("name")).alias("target_id"), F.lit("imports").alias("type"), "file_path", "start_line", "extra")
    boxes = extracted.where("record = 'def' and kind = 'method' and container is not null").select(_named(F.col("container"), F.col("file_path")).alias("source_id"), node_id("kind", "file_path", "name", "start_line").alias("target_id"), F.lit("contains").alias("type"), "file_path", "start_line", F.lit(None).cast("string").alias("extra"))
    made = (F.col("type") == "calls") & (F.col("extra") == "new")
    properties = F.to_json(
        F.struct(
            F.col("file_path").alias("filePath"),
            F.col("start_line").cast("string").alias("line"),
            F.when(made, "true").alias("constructor"),
            F.when((F.col("type") == "calls") & ~made, F.col("extra")).alias("object"),
            F.when(F.col("type") == "imports", F.regexp_replace("extra", r"^\*,?", "")).alias("names"),
            F.when((F.col("type") == "imports") & F.startswith("extra", F.lit("*")), "true").alias("reexport"),
        )
    )
    return named.unionByName(imports).unionByName(boxes).where("source_id <> target_id").select("source_id", "target_id", "type", properties.alias("properties"))


def reference_edges(extracted: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct (source_id, target_id, type) of `edges_of`."""
    return edges_of(extracted, nodes).select("source_id", "target_id", "type").distinct()


def resolve_imports(extracted: DataFrame, nodes: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges from files to the symbols they import, unresolved references).

    A relative or alias specifier is the first existing of its candidates; named imports go to the symbols of that name
    in the file, others to all it exports.
    """
    refs = extracted.where("record = 'ref' and kind = 'imports' and name rlike '^(?:\\\\.{1,2}/|@/|~/)'").select("file_path", F.col("name").alias("specifier"), F.col("start_line").alias("line"), F.when(~F.startswith("extra", F.lit("*")), F.col("extra")).alias("names")).distinct()
    s = F.col("specifier")
    base = resolve_dots(F.when(s.rlike("^[@~]/"), F.concat(F.lit("src/"), F.expr("substring(specifier, 3)"))).otherwise(F.concat(directory(F.col("file_path")), F.lit("/"), s)))
    tried = refs.withColumn("base", base).select("*", F.posexplode(F.array(*[F.lit(x) for x in ["", *SUFFIXES, "/__init__.py"]])).alias("pos", "suffix")).withColumn("target_file", F.concat("base", "suffix"))
    hit = tried.join(files.select(F.col("file_path").alias("target_file")).distinct(), "target_file", "left_semi")
    best = hit.groupBy("file_path", "specifier", "line", "names").agg(F.min_by("target_file", "pos").alias("target_file"))
    lost = refs.join(best, ["file_path", "specifier", "line"], "left_anti").select("file_path", "specifier", "line")
    named = best.select("file_path", "target_file", F.explode(F.split("names", ",")).alias("name"))
    by_name = named.join(nodes.select("name", F.col("file_path").alias("target_file"), "id"), ["target_file", "name"])
    plain = best.where("names is null").join(nodes.where("exported").select(F.col("file_path").alias("target_file"), "id"), "target_file")
    edges = by_name.select("file_path", "id").unionByName(plain.select("file_path", "id")).distinct()
    return edges.select(F.concat(F.lit("file:"), F.col("file_path")).alias("source_id"), F.col("id").alias("target_id"), F.lit("imports").alias("type")), lost


# What tells a route file or a registration, per framework: (name, path pattern, body pattern).
ROUTES = [
    ("express", r"\.(?:js|ts|jsx|tsx)$", r"\.(?:get|post|put|delete|patch|use|all)\("),
    ("django", r"(?:^|/)urls\.py$", r"\b(?:path|re_path|url)\("),
    ("rails", r"(?:^|/)routes\.rb$", r"\b(?:get|post|put|delete|resources?)\b"),
    ("laravel", r"(?:^|/)(?:routes/|web\.php$|api\.php$)", r"Route::"),
    ("spring", r"\.(?:java|kt)$", r"@(?:RestController|Controller|RequestMapping|GetMapping|PostMapping|PutMapping|DeleteMapping|PatchMapping)\b"),
]


def framework_edges(nodes: DataFrame) -> DataFrame:
    """(source_id, target_id, type, framework): registrations to the functions and classes they name.

    Bodies are cut to words, and a word means the symbol that `resolve_names` gives it, so a name that very many symbols
    have makes one edge.
    """
    rules = F.coalesce(*[F.when(F.col("file_path").rlike(p) & F.col("body").rlike(b), F.lit(n)) for n, p, b in ROUTES])
    words = F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"([A-Za-z_$][\w$]*)"), F.lit(1))))
    src = nodes.withColumn("framework", rules).where("framework is not null").select("id", "framework", "file_path", words.alias("name"))
    found = resolve_names(src, nodes.where("type in ('function', 'method', 'class')")).where("id <> target_id and not startswith(target_id, 'unresolved:')")
    return found.select(F.col("id").alias("source_id"), "target_id", F.lit("references").alias("type"), "framework").distinct()


def resolve_barrel(edges: DataFrame) -> DataFrame:
    """(source_id, target_id, type, properties): imports from files that only export again lead one hop on.

    `edges` are file-to-file imports with properties; those with `reexport` are the hops. New edges have barrel = true.
    """
    hop = edges.where(F.get_json_object("properties", "$.reexport") == "true").select(F.col("source_id").alias("via"), F.col("target_id").alias("beyond"))
    through = edges.where("type = 'imports'").select("source_id", F.col("target_id").alias("via")).distinct().join(hop.distinct(), "via").where("source_id <> beyond")
    return through.select("source_id", F.col("beyond").alias("target_id"), F.lit("imports").alias("type"), F.to_json(F.struct(F.lit("true").alias("barrel"))).alias("properties")).distinct()


def is_pascal_case(name: Column) -> Column:
    return name.rlike("^[A-Z]") & name.rlike("[a-z]") & ~name.rlike("[_\\-]")


def react_components(nodes: DataFrame) -> DataFrame:
    """(source_id, target_id, type): components of one name in different files.

    Each component of a name refers to the name's first one in another file, so a name that very many files have stays
    linear: the first refers to the second, all others to the first.
    """
    parts = nodes.where(F.col("type").isin("function", "class", "variable") & F.lower("language").isin("tsx", "jsx", "typescript", "javascript") & is_pascal_case(F.col("name"))).select("id", "name", "file_path", "start_line").distinct()
    per_file = parts.groupBy("name", "file_path").agg(F.min(F.struct("start_line", "id")).alias("own"))
    low = per_file.groupBy("name").agg(F.min(F.struct("file_path", "own")).alias("one"), F.max(F.struct("file_path", "own")).alias("last"))
    low = low.where("one.file_path <> last.file_path")
    second = per_file.join(low.select("name", "one"), "name").where("file_path <> one.file_path").groupBy("name").agg(F.min(F.struct("file_path", "own")).alias("two"))
    ends = low.select("name", "one").join(second, "name")
    out = parts.join(ends, "name")
    target = F.when(F.col("file_path") == F.col("one.file_path"), F.col("two.own.id")).otherwise(F.col("one.own.id"))
    return out.select(F.col("id").alias("source_id"), target.alias("target_id"), F.lit("references").alias("type"))
