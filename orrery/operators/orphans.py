"""References to records that do not exist (problem 7).

Direct orphans are references whose record does not live at the time of the reference. The cascade then treats children
of orphaned records as indirectly orphaned and iterates semi-joins down the foreign-key graph to a fixpoint.

Defined results: null references are none; an empty string is a reference to nothing and so an orphan; a reference
without a time is an orphan, as nothing is known to live then; repeated rows count once; empty tables give no rows.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.paths import canonical_path, directory, resolve_dots
from orrery.session import cut, written

# What may be added to a specifier to give a file.
SUFFIXES = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", ".py", ".rs", ".go", ".java"]


def first_seen(hashes: DataFrame) -> DataFrame:
    """(file_path canonical, seen): the earliest row of each file."""
    return (
        hashes.select(canonical_path(F.col("file_path")).alias("file_path"), "indexed_at")
        .where(F.col("file_path").isNotNull() & F.col("indexed_at").isNotNull())
        .groupBy("file_path")
        .agg(F.min("indexed_at").alias("seen"))
    )


def lifetimes(nodes: DataFrame) -> DataFrame:
    """(node_id, born, died?) without repeats."""
    return (
        nodes.where(F.col("id").isNotNull() & F.col("indexed_at").isNotNull())
        .select(F.col("id").alias("node_id"), F.col("indexed_at").alias("born"), F.col("deleted_at").alias("died"))
        .distinct()
    )


def edge_references(edges: DataFrame) -> DataFrame:
    """(ref_id, side, ref, at): the ends of edges that refer to nodes or files."""
    ends = F.array(F.struct(F.lit("source").alias("side"), F.col("source_id").alias("ref")), F.struct(F.lit("target").alias("side"), F.col("target_id").alias("ref")))
    return (
        edges.select(F.col("id").alias("ref_id"), F.col("indexed_at").alias("at"), F.explode(ends).alias("e"))
        .select("ref_id", "e.side", "e.ref", "at")
        .where(F.col("ref").isNotNull() & ~F.col("ref").startswith("module:") & ~F.col("ref").startswith("unresolved:"))
    )


def orphan_nodes(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """References to node ids without a row of that id that lives at the time. A hot id is split by AQE: the left side of an anti-join may be."""
    lives = (F.col("ref") == F.col("node_id")) & (F.col("born") <= F.col("at")) & (F.col("died").isNull() | (F.col("at") < F.col("died")))
    return refs.where(~F.col("ref").startswith("file:")).join(lifetimes(nodes), lives, "left_anti")


def orphan_files(refs: DataFrame, hashes: DataFrame) -> DataFrame:
    """References `file:{path}` to files that no row of file_hashes shows by then."""
    files = refs.where(F.col("ref").startswith("file:")).withColumn("__path", canonical_path(F.expr("substring(ref, 6)")))
    known = (F.col("__path") == F.col("file_path")) & (F.col("seen") <= F.col("at"))
    return files.join(first_seen(hashes), known, "left_anti").drop("__path")


def specifier_path(specifier: Column, file_path: Column) -> Column:
    """The path that a relative or alias specifier means; null if it counts as no reference."""
    own = canonical_path(file_path)
    base = F.when(specifier.startswith("./") | specifier.startswith("../"), F.concat(directory(own), F.lit("/"), specifier)).when(
        specifier.startswith("@/") | specifier.startswith("~/"), F.concat(F.element_at(F.split(own, "/"), 1), F.lit("/src/"), F.expr("substring(__spec, 3)"))
    )
    return resolve_dots(base)


def orphan_specifiers(unresolved: DataFrame, hashes: DataFrame) -> DataFrame:
    """(ref_id, path, at) of the specifiers that no known file answers.

    Each file offers the names under which it can be imported, so the references need no candidates of their own.
    """
    refs = (
        unresolved.withColumn("__spec", F.col("specifier"))
        .select(F.col("id").alias("ref_id"), specifier_path(F.col("__spec"), F.col("file_path")).alias("path"), F.col("seen_at").alias("at"))
        .where(F.col("path").isNotNull())
    )
    f = F.col("file_path")
    names = F.array(f, *[F.when(f.endswith(s), F.substring(f, F.lit(1), F.length(f) - len(s))) for s in SUFFIXES])
    offered = first_seen(hashes).select(F.explode(F.array_compact(names)).alias("name"), "seen").groupBy("name").agg(F.min("seen").alias("seen"))
    return refs.join(offered, (F.col("path") == F.col("name")) & (F.col("seen") <= F.col("at")), "left_anti")


def direct_orphans(edges: DataFrame, unresolved: DataFrame, nodes: DataFrame, hashes: DataFrame) -> DataFrame:
    """(src_table, ref_id, side, at), one row per orphan reference."""
    refs = edge_references(edges)
    of_edges = orphan_nodes(refs, nodes).unionByName(orphan_files(refs, hashes)).select(F.lit("edges").alias("src_table"), "ref_id", "side", "at")
    of_imports = orphan_specifiers(unresolved, hashes).select(F.lit("unresolved_refs").alias("src_table"), "ref_id", F.lit("specifier").alias("side"), "at")
    return of_edges.unionByName(of_imports).distinct()


def orphan_records(edges: DataFrame, orphans: DataFrame) -> DataFrame:
    """(ref): what the orphan references of `edges` mean, whatever their edge type and side."""
    refs = edge_references(edges)
    lost = orphans.where(F.col("src_table") == "edges").select(F.col("ref_id").alias("__id"), F.col("side").alias("__side"), F.col("at").alias("__at"))
    same = (F.col("ref_id") == F.col("__id")) & (F.col("side") == F.col("__side")) & F.col("at").eqNullSafe(F.col("__at"))
    return refs.join(lost, same, "left_semi").select("ref").distinct()


def cascade(edges: DataFrame, lost: DataFrame, child_types: tuple[str, ...] = ("contains",)) -> DataFrame:
    """Records orphaned by inheritance: (node_id, depth, kind). `lost` has the orphan records (ref).

    The children (targets of edges of a child type) of an orphan record are inherited orphans of depth 1, and their own
    children follow, to the fixpoint: each round is a semi-join with the last round's records and an anti-join with all
    earlier ones, so it ends, however deep the tree. Parents that are orphans themselves come out with depth 0 and kind
    `direct`; orphans without children only where another's children hold them.
    """
    links = edges.where(F.col("type").isin(*child_types) & F.col("source_id").isNotNull() & F.col("target_id").isNotNull())
    pairs = written(links.select("source_id", "target_id").distinct())
    parents = pairs.select(F.col("source_id").alias("ref"))
    found = frontier = cut(lost.join(parents, "ref", "left_semi").select(F.col("ref").alias("node_id"), F.lit(0).alias("depth")))
    for depth in itertools.count(1):
        step = pairs.join(frontier.select(F.col("node_id").alias("source_id")), "source_id", "left_semi").select(F.col("target_id").alias("node_id")).distinct()
        frontier = cut(step.join(found.select("node_id"), "node_id", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return found.withColumn("kind", F.when(F.col("depth") == 0, "direct").otherwise("inherited"))
        found = found.unionByName(frontier)
        if depth % 10 == 0:  # so that the union stays small
            found = cut(found)


class OrphanReferences:
    """All orphan references of the tables: the direct ones, then the cascade down the child edges from their records.

    `direct`: (src_table, ref_id, side, at). `records`: (node_id, depth, kind) of the cascade.
    """

    def __init__(self, edges: DataFrame, unresolved: DataFrame, nodes: DataFrame, hashes: DataFrame, child_types: tuple[str, ...] = ("contains",)):
        self.edges, self.unresolved = edges, unresolved
        self.direct = written(direct_orphans(edges, unresolved, nodes, hashes))
        self.lost = written(orphan_records(edges, self.direct))
        self.records = cascade(edges, self.lost, child_types)

    def references(self) -> DataFrame:
        """(src_table, ref_id, side, at, kind), distinct.

        Inherited are the references of `edges` to or from records orphaned by inheritance that aren't direct, and, with
        side `source`, the rows of unresolved_refs whose source_id is an orphan record, direct or inherited. That's besides
        their specifier, which is a reference of its own.
        """
        heirs = self.records.where("kind = 'inherited'").select(F.col("node_id").alias("ref"))
        via = edge_references(self.edges).distinct().join(heirs, "ref", "left_semi")
        via = via.join(self.direct.where("src_table = 'edges'").select("ref_id", "side"), ["ref_id", "side"], "left_anti").select(F.lit("edges").alias("src_table"), "ref_id", "side", "at")
        own = self.unresolved.select(F.col("id").alias("ref_id"), F.col("source_id").alias("ref"), F.col("seen_at").alias("at")).distinct()
        own = own.join(self.lost.unionByName(heirs).distinct(), "ref", "left_semi").select(F.lit("unresolved_refs").alias("src_table"), "ref_id", F.lit("source").alias("side"), "at")
        return self.direct.withColumn("kind", F.lit("direct")).unionByName(via.unionByName(own).withColumn("kind", F.lit("inherited")))

    def report(self) -> DataFrame:
        """(src_table, month, kind, n_refs): counts per table and month."""
        month = F.date_format("at", "yyyy-MM").alias("month")
        return self.references().groupBy("src_table", month, "kind").agg(F.count(F.lit(1)).alias("n_refs"))
