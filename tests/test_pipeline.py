"""Extraction, snapshots, history, streaming, evaluation, reports, and the driver's contract."""

import subprocess

import pytest
from pyspark.sql import functions as F

from orrery.operators import evaluate, extract, reports, store
from orrery.sources import history, tree
from orrery.streaming import watch

FILES = {
    "src/app.ts": "import { load } from './lib/store'; import { z } from './missing';\n// Starts the thing.\nexport function main() {\n  load('x');\n}\nexport class Base {}\nexport class App extends Base {\n  run(n: number): void {\n    main();\n  }\n}\n",
    "src/lib/store.ts": "export const load = (p) => { return p; };\nexport type T = string;\n",
    "src/tool.py": '"""doc"""\nimport os\nfrom .lib import x\nclass A(Base):\n    """An A."""\n    def go(self):\n        return helper()\n\ndef helper():\n    return 1\n',
    "src/main.go": "package main\n\nfunc Run(a int) error {\n\treturn nil\n}\n\ntype S struct {\n}\n",
    "src/lib.rs": "pub fn go(x: u8) -> u8 {\n    x\n}\npub struct P {}\n",
    "src/bad.py": "def (:\n",
    "src/empty.ts": "",
}


def test_extraction(spark):
    files = spark.createDataFrame([(p, tree.LANGUAGE_OF[p.rsplit(".", 1)[1]], c) for p, c in FILES.items()] + [("x.zig", "zig", "fn a() void {}"), ("n.ts", None, None)], "file_path string, language string, content string")
    found = extract.extract(files)
    nodes = extract.nodes_of(found)
    names = {(r.type, r.name, r.file_path) for r in nodes.collect()}
    assert {("function", "main", "src/app.ts"), ("class", "App", "src/app.ts"), ("method", "run", "src/app.ts"), ("function", "load", "src/lib/store.ts"), ("class", "A", "src/tool.py"), ("method", "go", "src/tool.py"), ("function", "Run", "src/main.go"), ("function", "go", "src/lib.rs")} <= names
    assert {r.qualified_name for r in nodes.where("name = 'run'").collect()} == {"App.run"}
    assert "Starts" in nodes.where("name = 'main'").first().doc_comment
    e = {(r.source_id, r.target_id, r.type) for r in extract.reference_edges(found, nodes).collect()}
    assert ("method:src/app.ts:run:8", "function:src/app.ts:main:3", "calls") in e
    assert ("class:src/app.ts:App:7", "method:src/app.ts:run:8", "contains") in e
    assert ("function:src/app.ts:main:3", "function:src/lib/store.ts:load:1", "calls") in e
    assert any(t == "extends" and d == "class:src/app.ts:Base:6" for _, d, t in e)
    edges, lost = extract.resolve_imports(found, nodes, files)
    assert ("file:src/app.ts", "function:src/lib/store.ts:load:1") in {(r.source_id, r.target_id) for r in edges.collect()}
    assert {r.specifier for r in lost.collect()} == {"./missing"}


def test_tree_and_git(spark, tmp_path):
    for p, c in {**FILES, "node_modules/x.js": "1", ".hidden/a.py": "1", "notes.md": "x", "package.json": '{"dependencies": {"express": "^4.18.2"}, "devDependencies": {"jest": "29.0"}}', "skip.py": "x = 1"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(c)
    (tmp_path / "src" / "latin.py").write_bytes(b"x = '\xff'")
    (tmp_path / ".gitignore").write_text("skip.py\n")
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=A B", "-c", "user.email=a@b.example", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "first | with pipe")
    (tmp_path / "src/app.ts").write_text("export const a = 1;\n")
    got = {r.file_path for r in tree.scan_tree(spark, str(tmp_path)).collect()}
    assert got == set(FILES) - {"src/empty.ts"}
    m = spark.createDataFrame([("package.json", (tmp_path / "package.json").read_text())], "path string, content string")
    assert {(r.name, r.version) for r in tree.detect_frameworks(m).collect()} == {("express", "4.18.2"), ("jest", "29.0")}
    log = history.parse_log(history.log_records(spark, history.run_git(str(tmp_path), "log", "--numstat", history.LOG_FORMAT)))
    assert {r.subject for r in log.collect()} == {"first | with pipe"}
    assert history.hotspots(log).count() > 5 and history.contributors(log).first().commits == 1
    blame = history.parse_blame(history.text_rows(spark, history.run_git(str(tmp_path), "blame", "--porcelain", "HEAD", "--", "src/lib.rs"))).orderBy("line_no").collect()
    assert [b.content for b in blame] == FILES["src/lib.rs"].rstrip("\n").split("\n") and {b.author for b in blame} == {"A B"}
    status = history.parse_status(history.text_rows(spark, history.run_git(str(tmp_path), "status", "--porcelain")))
    assert ("src/app.ts", "unstaged") in {(r.file_path, r.state) for r in status.collect()}
    assert history.commit_diff(history.text_rows(spark, history.run_git(str(tmp_path), "show", "--numstat", "--format=", "HEAD"))).count() > 5
    with pytest.raises(ValueError):
        history.run_git(str(tmp_path), "log\0")


def test_store(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2), ("b", 3), ("c", 1)], "k string, v int")
    assert {tuple(r) for r in store.upsert(old, new, ["k"]).collect()} == {("a", 1), ("b", 3), ("c", 1)}
    nodes = spark.createDataFrame([("x", "f"), ("y", "g")], "id string, file_path string")
    edges = spark.createDataFrame([("x", "y", "calls"), ("y", "z", "calls"), ("file:h", "z", "imports")], "source_id string, target_id string, type string")
    n, e = store.delete_files(nodes, edges, spark.createDataFrame([("f",)], "file_path string"))
    assert {r.id for r in n.collect()} == {"y"} and e.count() == 2


def test_watch(spark, tmp_path):
    src, seen = tmp_path / "src", {}
    src.mkdir()
    (src / "a.py").write_text("x = 1")

    def reindex(df, n):
        seen[n] = {r.file_path.rsplit("/", 1)[1]: r.content for r in df.collect()}

    watch.watch(spark, str(src), reindex, str(tmp_path / "cp")).awaitTermination()
    (src / "b.py").write_text("y = 2")
    watch.watch(spark, str(src), reindex, str(tmp_path / "cp")).awaitTermination()
    assert list(seen.values()) == [{"a.py": "x = 1"}, {"b.py": "y = 2"}]


def test_evaluate(spark):
    f = spark.createDataFrame([("q", "a"), ("q", "b"), ("r", "a")], "k string, v string")
    e = spark.createDataFrame([("q", "a"), ("q", "c"), ("s", "a")], "k string, v string")
    got = {r.k: (r.precision, r.recall) for r in evaluate.prf(f, e, "k", "v").collect()}
    assert got == {"q": (0.5, 0.5), "r": (0.0, 0.0), "s": (0.0, 0.0)}
    ranks = spark.createDataFrame([("q", "x", 1), ("q", "a", 2)], "k string, v string, rank int")
    assert {r.k: r.rr for r in evaluate.reciprocal_rank(ranks, e, "k", "v").collect()} == {"q": 0.5, "s": 0.0}
    assert evaluate.macro(evaluate.prf(f, e, "k", "v")).count() == 1


def test_hash_and_mermaid(spark):
    ids = ["abc", "", "function:a.ts:f:1", "日本"]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    for r in df.select("id", reports.source_hash(F.col("id")).alias("h")).collect():
        assert r.h == reports.base36(reports.hash31(r.id))
    assert reports.hash31("abc") == 96354
    edges = spark.createDataFrame([("a", "b", "calls"), ("a", "ghost", "calls")], "source_id string, target_id string, type string")
    drawn = reports.mermaid(edges, spark.createDataFrame([("a", 'A"x'), ("b", "B")], "id string, name string"))
    assert drawn.startswith("graph LR") and "A_x" in drawn and "ghost" not in drawn


def test_contract(spark, sf):
    import __spark_entry__ as entry

    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 80
    assert entry.entry(spark).count() > 0


def test_core_needs_no_subpackage():
    import pathlib

    root = pathlib.Path(__file__).resolve().parent.parent / "orrery"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "orrery.llm" not in p.read_text(), p


@pytest.mark.parametrize("name", ["p2_found", "p4_degrees", "p7_found", "callers", "languages", "dead_code", "bm25_topk", "rule_findings"])
def test_against_sql(spark, sf, name):
    import pathlib
    import sys

    import duckdb

    sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent / "tools"))
    import compare

    import __spark_entry__ as entry

    con = duckdb.connect()
    for p in pathlib.Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    df = entry.queries()[name](spark, sf)
    cur = con.execute(entry.oracle_sql()[name])
    assert compare.rows_of(df.columns, df.collect()) == compare.rows_of([d[0] for d in cur.description], cur.fetchall())
