"""Rows with JSON, settings, workspaces, tools, embeddings, tasks, security over whole files, history, evaluation."""

import subprocess

import pytest
from pyspark.sql import functions as F

from orrery.operators import embed, evaluate, search, security, store
from orrery.sources import config, history, rows, tree
from orrery.streaming import tasks


def test_json_rows(spark):
    nodes = spark.createDataFrame([("a", "Field", '{"startColumn": 2, "endColumn": 5, "exported": true, "body": "x"}'), ("b", "const", "{broken"), ("c", "class", None), ("d", "class", "")], "id string, type string, metadata string")
    got = {r.id: r for r in rows.decode_nodes(nodes).collect()}
    assert (got["a"].kind, got["a"].meta_start_column, got["a"].meta_exported, got["a"].meta_body) == ("property", 2, True, "x")
    assert got["b"].kind == "constant" and got["b"].meta_exported is None and got["c"].meta_body is None
    assert {r.id for r in rows.not_exported(nodes).collect()} == {"b", "c", "d"}
    edges = spark.createDataFrame([("s", "t", "calls", '{"filePath": "f", "line": "7", "object": "o"}'), ("s", "u", "calls", '{"line": "x"}'), ("s", "v", "calls", "{}"), ("s", "w", "calls", None), ("s", "x", "calls", '{"line": "5')], "source_id string, target_id string, type string, properties string")
    dec = rows.decode_edges(edges)
    got = {r.target_id: (r.file_path, r.line, r.property_map) for r in dec.collect()}
    assert got["t"] == ("f", 7, {"filePath": "f", "line": "7", "object": "o"}) and got["u"][1] == 0 and got["v"] == (None, 0, None) == got["w"]
    assert rows.edge_props_json(dec.where("target_id = 't'")).first().properties == '{"filePath":"f","line":"7","object":"o"}'
    one = spark.createDataFrame([("a", 1, 2, "b" * 5000, None)], "id string, start_column int, end_column int, body string, exported boolean")
    assert len(rows.node_meta_json(one).first().metadata) < 4200 and rows.json_result(one.select("id")).first().json == '{"id":"a"}'
    assert rows.decode_nodes(nodes.limit(0)).count() == 0


def test_settings(tmp_path):
    (tmp_path / "u.yml").write_text("preset: minimal\ntoken_budget: 100\ncontexts: {src: code}\n")
    (tmp_path / "p.yml").write_text("token_budget: 200\ncontexts: {docs: text}\n")
    s = config.load_settings(str(tmp_path / "u.yml"), str(tmp_path / "p.yml"), {"ORRERY_MAX_TOOL_COUNT": "2", "ORRERY_DISABLED_TOOLS": "b", "OTHER": "x"}, {"preset": "full"})
    assert (s.preset, s.token_budget, s.max_tool_count, s.disabled_tools, s.contexts) == ("full", 200, 2, ("b",), {"src": "code", "docs": "text"})
    assert config.load_settings(environment={}) == config.Settings() and config.load_settings(str(tmp_path / "none.yml"), environment={}) == config.Settings()
    with pytest.raises(ValueError):
        config.load_settings(given={"nonsense": 1}, environment={})
    tools = [("a", "core"), ("b", "core"), ("c", "graph"), ("d", "git")]
    assert config.filter_tools(tools, s) == ["a", "c"]
    assert config.filter_tools(tools, config.Settings(preset="minimal", enabled_tools=("d",))) == ["a", "b", "d"]
    assert config.validate_path(str(tmp_path), "u.yml").name == "u.yml"
    for bad in ("../x", "/etc/passwd"):
        with pytest.raises(ValueError):
            config.validate_path(str(tmp_path), bad)


def test_workspace(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.py").write_text("x = 1\n")
    w = config.Workspace(str(tmp_path / "w.yml"))
    assert w.scan(spark).count() == 0
    w.add("one", str(tmp_path / "one"))
    w.add("two", str(tmp_path / "two"))
    with pytest.raises(ValueError):
        w.add("one", str(tmp_path / "one"))
    with pytest.raises(ValueError):
        w.add("no", str(tmp_path / "no"))
    again = config.Workspace(str(tmp_path / "w.yml"))
    assert {(r.repo, r.file_path) for r in again.scan(spark).collect()} == {("one", "a.py"), ("two", "a.py")} and again.table(spark).count() == 2
    assert again.remove("one") and not again.remove("one") and list(config.Workspace(str(tmp_path / "w.yml")).repos) == ["two"]


def test_embeddings(spark, tmp_path):
    df = spark.createDataFrame([(1, "parse the token"), (2, "token parser"), (3, "draw a window"), (4, None), (5, "")], "id long, t string")
    path = str(tmp_path / "v")
    first = {r.key: r.embedding for r in embed.embed_and_store(df, "id", "t", path).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(first[a], first[b]))
    assert set(first) == {1, 2, 3, 5} and dot(1, 2) > dot(1, 3) and abs(dot(1, 1) - 1) < 1e-5 and not any(first[5])
    seen = spark.sparkContext.accumulator(0)

    def load():
        def model(texts):
            seen.add(len(texts))
            return embed.HashedWords()(texts)

        return model

    changed = spark.createDataFrame([(1, "parse the token"), (3, "draw a circle"), (6, "new")], "id long, t string")
    second = {r.key: r.embedding for r in embed.embed_and_store(changed, "id", "t", path, load).collect()}
    assert set(second) == {1, 3, 6} and second[1] == first[1] and second[3] != first[3] and seen.value == 2


def test_tasks():
    now = [0.0]
    r = tasks.TaskRegistry(10, lambda: now[0])
    a, b = r.start("one"), r.start()
    assert r.get(a) == {"state": "working", "message": "one", "result": None}
    assert r.finish(a, result=5) and not r.finish(a) and not r.finish("x") and r.get(a)["result"] == 5
    now[0] = 11.0
    assert r.get(a) is None and r.states() == {b: "working"}
    with pytest.raises(ValueError):
        r.finish(b, "working")
    c = tasks.CacheCounter()
    assert c.rate() == 0
    c.hits, c.misses = 3, 1
    assert c.rate() == 0.75


def test_reindex(spark):
    from orrery.operators import extract

    files = spark.createDataFrame([("a.py", "python", "from .b import g\ndef f():\n    return g()\n"), ("b.py", "python", "def g():\n    return 1\n")], "file_path string, language string, content string")
    found = extract.extract(files)
    nodes = extract.nodes_of(found)
    edges = extract.reference_edges(found, nodes)
    n, e = tasks.reindex(nodes, edges, spark.createDataFrame([("a.py", "python", "def f2():\n    return g()\n")], "file_path string, language string, content string"))
    assert {r.name for r in n.collect()} == {"f2", "g"} and ("function:a.py:f2:1", "function:b.py:g:1", "calls") in {tuple(r) for r in e.collect()}


def test_whole_file_rules(spark, tmp_path):
    text = "x = 1\r\nrun(\n  eval (y), eval(z))\npassword = 'hunter22'\n"
    rules = [("A", "a", "high", "CWE-1", "A01", "", r"run\(\s*eval", "m", None, "other"), ("B", "b", "low", None, None, "python", r"\beval\s*\(", "m", None, "other")]
    df = spark.createDataFrame([("f.py", "python", text), ("g.go", "go", text), ("tests/t.py", "python", text), ("n", None, None)], "file_path string, language string, content string")
    got = {(r.key, r.line_no, r.column_no, r.rule_id, r.matched_text) for r in security.scan_files(df, rules, exclude_tests=True).collect()}
    assert got == {("f.py", 2, 1, "A", "run(\n  eval"), ("g.go", 2, 1, "A", "run(\n  eval"), ("f.py", 3, 3, "B", "eval ("), ("f.py", 3, 13, "B", "eval(")}
    assert security.scan_files(df, rules).first().severity == "high"
    assert {r[0] for r in security.owasp_rules(rules)} == {"A"} == {r[0] for r in security.cwe_rules(rules)} and security.scan(df, "file_path", "content", rules=[]).count() == 0
    report, code = security.ci_report(security.scan_files(df))
    assert code == 1 and "| critical | INJ-001 | f.py:3:3 |" in report and security.ci_report(security.scan_files(df.limit(0))) == ("## Security findings\n\nNone.", 0)
    for p in ("a.py", "tests/t.py", ".hid/x.py", "node_modules/m.py", "notes.txt"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("eval(x)\n")
    assert {r.file_path for r in tree.scan_dir_security(spark, str(tmp_path)).collect()} == {"a.py", "tests/t.py"}
    assert {r.file_path for r in tree.scan_dir_security(spark, str(tmp_path), exclude_tests=True).collect()} == {"a.py"}


def test_symbol_and_file_history(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=A", "-c", "user.email=a@b.example", *a], check=True, capture_output=True)
    git("init", "-q")
    for n, text in enumerate(("def f():\n    pass\n", "def f():\n    pass\n\ndef special():\n    pass\n", "def f():\n    return 1\n\ndef special():\n    pass\n")):
        (tmp_path / "a.py").write_text(text)
        (tmp_path / f"b{n}.py").write_text("x\n")
        git("add", ".")
        git("commit", "-qm", f"c{n}")
    assert [r.subject for r in history.symbol_history(spark, str(tmp_path), "special").select("subject").distinct().collect()] == ["c1"]
    assert {r.subject for r in history.file_history(spark, str(tmp_path), "a.py").collect()} == {"c0", "c1", "c2"}
    assert {r.file_path for r in history.recent_changes(spark, str(tmp_path), 1).collect()} == {"a.py", "b2.py"}
    with pytest.raises(ValueError):
        history.symbol_history(spark, str(tmp_path), "-x")
    assert history.parse_log(history.log_records(spark, "")).count() == 0


def test_unresolved(spark):
    refs = spark.createDataFrame([("s", "./a", "f", 1), ("s", "./b", "g", 2)], "source_id string, specifier string, file_path string, line int")
    more = store.add_unresolved(refs, refs.limit(1).unionByName(spark.createDataFrame([("t", "./c", "f", 3)], refs.schema)))
    assert more.count() == 3 and store.unresolved_of(more, "f").count() == 2 and store.count_unresolved(store.clear_unresolved(more, refs.where("file_path = 'f'"))).first().n == 1


def test_whole_evaluation(spark):
    nodes = spark.createDataFrame([("a", "f", "function", "x.ts"), ("b", "g", "function", "y.ts"), ("c", "h", "function", "y.ts"), ("m", "m", "module", "y.ts")], "id string, name string, type string, file_path string")
    edges = spark.createDataFrame([("a", "b", "calls"), ("a", "b", "imports")], "source_id string, target_id string, type string")
    hits = spark.createDataFrame([("q", "f", 1), ("q", "z", 2), ("q", "far", 11)], "query string, name string, rank int")
    t = lambda data, schema: spark.createDataFrame(data, schema)
    truth = {"search": t([("q", "f")], "query string, name string"), "callers": t([("g", "f"), ("g", "h")], "callee string, caller string"), "dead": t([("h",)], "name string"), "dependencies": t([("x.ts", "y.ts")], "file string, dependency string")}
    got = {r.part: (r.precision, r.recall, r.enough) for r in evaluate.run_evaluation(nodes, edges, hits, truth, 3, 2).collect()}
    assert got["search"] == (0.5, 1.0, True) and got["callers"] == (1.0, 0.5, True) and got["dead"] == (0.5, 1.0, True) and got["dependencies"] == (1.0, 1.0, True)
    assert got["overall"][:2] == (0.75, 0.875)


def test_ranks_of_all(spark):
    scores = spark.range(500).select("id", (F.col("id") % 37).cast("double").alias("score"))
    got = {r.id: r.rank for r in search.ranked(scores).collect()}
    want = sorted(range(500), key=lambda i: (-(i % 37), i))
    assert [got[i] for i in want] == list(range(1, 501)) and search.ranked(scores.limit(0)).count() == 0
