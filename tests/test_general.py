"""Incremental processing, skewed aggregates, orphan references."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from orrery.operators import incremental, orphans, skew


def ts(n):
    return dt.datetime(2025, 1, 1) + dt.timedelta(hours=n)


LISTING = "listing_id long, file_path string, content_hash string, language string, listed_at timestamp_ntz, extra string"
HASHES = "file_path string, content_hash string, indexed_at timestamp_ntz, extra string"
RUNS = "run_id int, started_at timestamp_ntz, finished_at timestamp_ntz, status string"


def test_changed_files(spark, tmp_path):
    runs = spark.createDataFrame([(1, ts(0), ts(10), "ok"), (2, ts(20), ts(30), "failed"), (3, ts(40), None, "running"), (4, ts(50), ts(60), "ok")], RUNS)
    hashes = spark.createDataFrame(
        [
            ("a.py", "H1", ts(1), "x"), ("./a.py", " sha256:h1 ", ts(2), None), ("b.py", "h2", ts(25), "x"), ("c.py", "h3", ts(0), "x"), ("c.py", "h4", ts(60), "x"), ("d.py", "h5", ts(45), "x"), ("e.py", None, ts(5), "x"), (None, "h", ts(5), "x"), ("f\\g.py", "h6", ts(5), "x"),
        ],
        HASHES,
    )
    listing = spark.createDataFrame(
        [
            (1, "a.py", "h1", "py", ts(100), ""), (2, "b.py", "h2", "py", ts(100), ""), (3, "c.py", "h3", "py", ts(90), ""), (4, "c.py", "h4", "py", ts(100), ""), (5, "d.py", "h5", None, ts(100), ""), (6, "e.py", "", None, ts(100), ""),
            (7, "f//g.py", "H6", None, ts(100), ""), (8, "h.py", "h7", None, ts(100), ""), (8, "h.py", "h7", None, ts(100), ""), (9, "i.py", "old", None, ts(100), ""), (10, "i.py", "new", None, ts(100), ""), (11, None, "h", None, ts(1), ""),
        ],
        LISTING,
    )
    roots = (str(tmp_path / str(n)) for n in range(9))
    got = sorted(r.file_path for r in incremental.changed_files(listing, hashes, runs, next(roots)).collect())
    assert got == ["b.py", "d.py", "h.py", "i.py"]
    for args, n in (((listing.limit(0), hashes, runs), 0), ((listing, hashes.limit(0), runs), 7), ((listing, hashes, runs.limit(0)), 7)):
        assert incremental.changed_files(*args, next(roots)).count() == n
    old = spark.createDataFrame([(1, "b.py", "h9", "py", ts(3), ""), (2, "b.py", "h2", "py", ts(4), ""), (3, "a.py", "h1", "py", ts(39), ""), (4, "a.py", "h0", "py", ts(2), ""), (5, "c.py", "h3", "py", ts(39), "")], LISTING)
    assert sorted(tuple(r)[:2] for r in incremental.changed_files(old, hashes, runs, next(roots)).collect()) == [("b.py", "h2"), ("c.py", "h3")]
    assert incremental.low_water_mark(runs).first()[0] == ts(40)
    assert incremental.low_water_mark(runs.limit(0)).first()[0] is None


def test_processor_survives_failures(spark, tmp_path):
    schema = "k string, v string, at long"
    source = spark.createDataFrame([("a", "1", 1), ("a", "1", 1), ("b", "1", 2), (None, "1", 3), ("c", None, 3)], schema)
    p = incremental.IncrementalProcessor(spark, str(tmp_path), "k", "v")
    assert p.run(source) == 0
    more = source.unionByName(spark.createDataFrame([("a", "2", 5), ("d", "1", 1)], schema))

    def boom(df):
        df.write.mode("overwrite").parquet(str(tmp_path / "partial"))
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        p.run(more, boom)
    assert p.batches() == [0]
    assert p.run(more) == 1
    assert p.run(more) == 2 and p.pending(more).count() == 0
    assert Counter((r.k, r.v) for r in p.output().collect()) == Counter([("a", "1"), ("b", "1"), ("a", "2"), ("d", "1")])
    assert p.pending(more.unionByName(spark.createDataFrame([("z", "1", 0)], schema)), "at", 1).count() == 0


@pytest.mark.parametrize("at", ["at", None])
def test_processor_takes_returning_versions(spark, tmp_path, at):
    """A -> B -> A: as a log with times, and as a snapshot without."""
    p = incremental.IncrementalProcessor(spark, str(tmp_path), "k", "v")
    log = [("f", "A", 1), ("g", "A", 1), ("f", "B", 2), ("f", "A", 3), ("f", "A", 4)]
    done = []
    for n, i in enumerate((2, 3, 4, 4, 5)):
        rows = log[:i] if at else [*{k: (k, v, t) for k, v, t in log[:i]}.values()]
        assert p.run(spark.createDataFrame(rows + rows, "k string, v string, at long"), at=at, reread_from=2 if at and n > 1 else None) == n
        done.append(sorted((r.k, r.v) for r in p.output(n).collect()))
    assert done == [[("f", "A"), ("g", "A")], [("f", "B")], [("f", "A")], [], []]


def test_two_runs_at_once(spark, tmp_path):
    """The later to commit fails, whatever it wrote, and nothing is lost or repeated."""
    schema = "k string, v string"
    p, q = (incremental.IncrementalProcessor(spark, str(tmp_path), "k", "v") for _ in range(2))
    source = spark.createDataFrame([("a", "1"), ("b", "1")], schema)

    def meanwhile(df):
        q.run(source.where("k = 'a'"))
        return df.withColumn("v", F.lit("spoilt"))

    with pytest.raises(Exception, match="exists"):
        p.run(source, meanwhile)
    assert [(r.k, r.v) for r in p.output().collect()] == [("a", "1")] and p.batches() == [0]
    assert p.run(source) == 1
    assert sorted((r.k, r.v) for r in p.output().collect()) == [("a", "1"), ("b", "1")]
    p.compact()
    p.compact()
    assert p.ledger().count() == 2 and p.pending(source).count() == 0
    assert p.run(source.unionByName(spark.createDataFrame([("c", "1"), ("a", "2")], schema))) == 2
    assert sorted((r.k, r.v, r.batch) for r in p.ledger().collect()) == [("a", "1", 0), ("a", "2", 2), ("b", "1", 1), ("c", "1", 2)]


def test_processor_takes_all_changes_of_a_run(spark, tmp_path):
    p = incremental.IncrementalProcessor(spark, str(tmp_path), "k", "v")
    rows = [("f", "A", None), ("f", "B", 2), ("f", "A", 3), ("f", "A", 4)]
    source = lambda x: spark.createDataFrame(x, "k string, v string, at long")
    p.run(source(rows), at="at")
    assert Counter((r.v, r.at) for r in p.output().collect()) == Counter([("A", None), ("B", 2), ("A", 3)])
    late = source([*rows, ("f", "C", 3), ("f", "B", 5)])
    assert sorted((r.v, r.at) for r in p.pending(late, "at").collect()) == [("A", 4), ("B", 5), ("C", 3)]


def test_counts_of_skewed_keys(spark):
    r = random.Random(4)
    rows = [("hot" if r.random() < 0.4 else f"t{r.randint(0, 60)}", r.choice(["calls", None]), None if r.random() < 0.1 else f"s{r.randint(0, 200)}", "x") for _ in range(4000)]
    e = spark.createDataFrame(rows, "target_id string, type string, source_id string, extra string")
    n, d = Counter(), defaultdict(set)
    for t, k, s, _ in rows:
        n[t, k] += 1
        if s is not None:
            d[t, k].add(s)
    got = {(x.target_id, x.type): (x.in_degree, x.distinct_sources) for x in skew.in_degrees(e).collect()}
    assert got == {k: (n[k], len(d[k])) for k in n}
    heavy = {(x.target_id, x.type) for x in skew.heavy_keys(e, 0.05).collect()}
    assert heavy == {k for k in n if n[k] >= 0.05 * len(rows)}
    assert skew.in_degrees(e.limit(0)).count() == 0 and skew.heavy_keys(e.limit(0)).count() == 0


def test_shard_plan_balances(spark):
    load = spark.createDataFrame([("a", 900), *[(f"k{i}", 10) for i in range(50)]], "k string, load long")
    plan = skew.plan_shards(load, ["k"], 8)
    row = plan.heavy.first()
    assert row.k == "a" and row.shards == len(row.shard_tasks) == 6 and len(set(row.shard_tasks)) == 6
    assert set(plan.buckets) <= set(range(8))


def test_salts_place_keys(spark):
    """The salted keys land, by Spark's own hash partitioning, so that the tasks are even."""
    left = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 5 == 0, "warm").otherwise(F.concat(F.lit("k"), F.col("id") % 300)).alias("k"), "id")
    right = left.select("k").distinct().withColumn("y", F.lit(1))
    joined = skew.skew_join(left, right, ["k"], tasks=8)
    sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 40_000 and len(sizes) == 8 and max(sizes) < 1.15 * 40_000 / 8
    assert joined.where("k = 'hot'").select(F.spark_partition_id()).distinct().count() > 3


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join(spark, how):
    left = spark.createDataFrame([("a" if i % 3 else f"b{i % 40}", i) for i in range(600)] + [(None, -1)], "k string, x int")
    right = spark.createDataFrame([("a", 1), ("a", 2), ("b3", 3), ("zz", 4)], "k string, y int")
    got = Counter(tuple(r) for r in skew.skew_join(left, right, ["k"], how).collect())
    assert got == Counter(tuple(r) for r in left.join(right, ["k"], how).collect())
    with pytest.raises(ValueError):
        skew.skew_join(left, right, ["k"], "full")


def test_orphans(spark):
    nodes = spark.createDataFrame([("n1", ts(0), None), ("n2", ts(0), ts(10)), ("n2", ts(20), None), ("n2", ts(20), None), (None, ts(0), None)], "id string, indexed_at timestamp_ntz, deleted_at timestamp_ntz")
    edges = spark.createDataFrame(
        [
            (1, "n1", "n2", "calls", ts(5)), (2, "n1", "n2", "calls", ts(15)), (3, None, "module:x", "imports", ts(5)), (4, "file:./a//b.ts", "unresolved:f", "calls", ts(5)), (5, "file:a/b.ts", "n9", "calls", ts(1)),
            (6, "n2", "kid", "contains", ts(15)), (7, "kid", "kid2", "contains", ts(30)), (2, "n1", "n2", "calls", ts(15)), (8, "", "n1", "calls", ts(5)), (9, "n1", "n1", "calls", None), (10, "n2", "n1", "calls", ts(10)),
        ],
        "id long, source_id string, target_id string, type string, indexed_at timestamp_ntz",
    )
    hashes = spark.createDataFrame([("a\\b.ts", ts(3)), ("r/src/x/index.ts", ts(0)), ("r/src/y.vue", ts(0)), (None, ts(0))], "file_path string, indexed_at timestamp_ntz")
    refs = spark.createDataFrame(
        [(1, "./x", "r/src/main.ts", ts(1)), (2, "../src/./x/index", "r/lib/m.ts", ts(1)), (3, "@/x", "./r/lib/deep/m.ts", ts(1)), (4, "~/y", "r/lib/m.ts", ts(1)), (5, "lodash", "r/a.ts", ts(1)), (6, "@scope/x", "r/a.ts", ts(1)), (7, "./x", "r/src/main.ts", dt.datetime(2024, 1, 1)), (8, None, "r/a.ts", ts(1)), (9, "./y.vue", "r/src/main.ts", ts(1))],
        "id long, specifier string, file_path string, seen_at timestamp_ntz",
    )
    got = {(r.src_table, r.ref_id, r.side) for r in orphans.direct_orphans(edges, refs, nodes, hashes).collect()}
    assert got == {
        ("edges", 2, "target"), ("edges", 5, "source"), ("edges", 5, "target"), ("edges", 6, "source"), ("edges", 6, "target"), ("edges", 7, "source"), ("edges", 7, "target"), ("edges", 8, "source"), ("edges", 9, "source"), ("edges", 9, "target"), ("edges", 10, "source"),
        ("unresolved_refs", 4, "specifier"), ("unresolved_refs", 7, "specifier"),
    }
    refs = refs.withColumn("source_id", F.lit(None).cast("string"))
    all_ = orphans.OrphanReferences(edges, refs, nodes, hashes)
    assert {(r.node_id, r.depth, r.kind) for r in all_.records.collect()} == {("n2", 0, "direct"), ("kid", 0, "direct"), ("kid2", 1, "inherited")}
    assert {(r.src_table, r.ref_id, r.side) for r in all_.references().where("kind = 'direct'").collect()} == got
    report = Counter()
    for r in all_.report().collect():
        report[r.src_table, r.kind] += r.n_refs
    assert report["edges", "direct"] == 11 and report["unresolved_refs", "direct"] == 2
    empty = orphans.OrphanReferences(edges.limit(0), refs.limit(0), nodes.limit(0), hashes.limit(0))
    assert empty.references().count() == 0 and empty.records.count() == 0


def test_cascade_has_no_bound(spark):
    pairs = [(i, f"n{i}", f"n{i + 1}", "contains") for i in range(60)] + [(999, "n60", "n7", "contains")]
    edges = spark.createDataFrame(pairs, "id long, source_id string, target_id string, type string")
    fall = orphans.cascade(edges, spark.createDataFrame([("n0",)], "ref string"))
    assert {r.node_id: r.depth for r in fall.collect()} == {f"n{i}": i for i in range(61)}


def test_cascade_from_any_orphan(spark):
    """A record that is an orphan through another edge type, or as a target, passes it on to its children by older edges."""
    nodes = spark.createDataFrame([(i, ts(0), ts(10) if i in ("gone", "aim") else None) for i in ("gone", "aim", "a", "b", "c", "live", "d")], "id string, indexed_at timestamp_ntz, deleted_at timestamp_ntz")
    edges = spark.createDataFrame(
        [(1, "gone", "a", "contains", ts(5)), (2, "a", "b", "contains", ts(5)), (3, "gone", "live", "calls", ts(20)), (4, "aim", "c", "contains", ts(5)), (5, "live", "aim", "calls", ts(20)), (6, "live", "d", "contains", ts(5))],
        "id long, source_id string, target_id string, type string, indexed_at timestamp_ntz",
    )
    hashes = spark.createDataFrame([("r/x.ts", ts(0))], "file_path string, indexed_at timestamp_ntz")
    refs = spark.createDataFrame([(i, s, "lodash", "r/m.ts", ts(1)) for i, s in enumerate(("gone", "b", "c", "live", "d", None, "gone"))], "id long, source_id string, specifier string, file_path string, seen_at timestamp_ntz")
    all_ = orphans.OrphanReferences(edges, refs.unionByName(refs), nodes, hashes)
    assert {(r.ref_id, r.side) for r in all_.direct.collect()} == {(3, "source"), (5, "target")}
    fall = all_.records
    assert {(r.node_id, r.depth, r.kind) for r in fall.collect()} == {("gone", 0, "direct"), ("aim", 0, "direct"), ("a", 1, "inherited"), ("b", 2, "inherited"), ("c", 1, "inherited")}
    report = {(r.src_table, r.kind): r.n_refs for r in all_.report().collect()}
    assert report == {("edges", "direct"): 2, ("edges", "inherited"): 4, ("unresolved_refs", "inherited"): 4}
