"""Snapshots of the graph: upserts, replacement and removal of files, as anti-joins and unions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new`, and those of `old` whose key it lacks. Of several new rows of a key the greatest counts."""
    rest = [c for c in old.columns if c not in keys]
    last = new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])
    return old.join(last.select(*keys), keys, "left_anti").select(*old.columns).unionByName(last.select(*old.columns))


def delete_files(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without those of the files: edges that touch a removed node, on either side, go too."""
    gone = nodes.join(files.select("file_path").distinct(), "file_path", "left_semi").select("id").distinct()
    kept = nodes.join(files.select("file_path").distinct(), "file_path", "left_anti").select(*nodes.columns)
    e = edges.join(gone.select(F.col("id").alias("source_id")), "source_id", "left_anti").join(gone.select(F.col("id").alias("target_id")), "target_id", "left_anti")
    return kept, e.select(*edges.columns)


def replace_files(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph with the files' symbols replaced. `new_edges` is resolved over all raw references, so edges from unchanged files come back."""
    n, e = delete_files(nodes, edges, files)
    return n.unionByName(new_nodes.select(*nodes.columns)), e.unionByName(new_edges.select(*edges.columns)).distinct()


def write_snapshot(df: DataFrame, root: str, name: str, version: int) -> str:
    """A new folder per version; readers take the one that the caller's pointer names."""
    path = f"{root}/{name}/v={version}"
    df.write.mode("overwrite").parquet(path)
    return path


def add_unresolved(old: DataFrame, new: DataFrame) -> DataFrame:
    """The unresolved references with new ones; the same source, specifier and line count once."""
    return old.unionByName(new.select(*old.columns)).dropDuplicates(["source_id", "specifier", "line"])


def unresolved_of(refs: DataFrame, file_path: str | None = None) -> DataFrame:
    """Unresolved references, of one file if asked."""
    return refs if file_path is None else refs.where(F.col("file_path") == file_path)


def clear_unresolved(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Without those of the files."""
    return refs.join(files.select("file_path").distinct(), "file_path", "left_anti").select(*refs.columns)


def count_unresolved(refs: DataFrame) -> DataFrame:
    """One row: how many distinct references there are."""
    return refs.distinct().agg(F.count(F.lit(1)).alias("n"))
