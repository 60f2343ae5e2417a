"""Rows with JSON columns: unpacked once at the boundary, columns afterwards, and packed again for an export.

Defined results: null, empty and broken JSON give null columns; a line that is no number is 0; unknown kinds are taken
loosely (see KINDS); other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Other names of kinds.
KINDS = {"field": "property", "package": "namespace", "const": "constant"}
MOST_META_BODY = 4096


def loose_kind(kind: Column) -> Column:
    """The kind of a symbol in lower case, by its usual name."""
    k = F.lower(F.trim(kind))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), k), k)


def decode_nodes(nodes: DataFrame) -> DataFrame:
    """The rows with meta_start_column, meta_end_column, meta_exported and meta_body of `metadata`, and the loose kind."""
    meta = F.from_json("metadata", "startColumn int, endColumn int, exported boolean, body string")
    return nodes.withColumn("__m", meta).select(
        *nodes.columns, loose_kind(F.col("type")).alias("kind"), F.col("__m.startColumn").alias("meta_start_column"), F.col("__m.endColumn").alias("meta_end_column"), F.col("__m.exported").alias("meta_exported"), F.col("__m.body").alias("meta_body")
    )


def decode_edges(edges: DataFrame) -> DataFrame:
    """The rows with file_path, line and the whole `properties` as a map."""
    props = F.from_json("properties", "map<string,string>")
    return edges.withColumn("__p", props).select(
        *[c for c in edges.columns if c not in ("file_path", "line")],
        F.try_element_at("__p", F.lit("filePath")).alias("file_path"),
        F.coalesce(F.expr("try_cast(try_element_at(__p, 'line') as int)"), F.lit(0)).alias("line"),
        F.when(F.size("__p") > 0, F.col("__p")).alias("property_map"),
    )


def node_meta_json(nodes: DataFrame) -> DataFrame:
    """(id, metadata): columns, exported flag and at most MOST_META_BODY characters of the body as one JSON object."""
    body = F.when(F.length("body") > MOST_META_BODY, F.substring("body", 1, MOST_META_BODY)).otherwise(F.col("body"))
    return nodes.select("id", F.to_json(F.struct(F.col("start_column").alias("startColumn"), F.col("end_column").alias("endColumn"), body.alias("body"), "exported")).alias("metadata"))


def edge_props_json(edges: DataFrame) -> DataFrame:
    """(source_id, target_id, type, properties) of edges with file_path, line and a map of further properties (or null)."""
    own = F.map_from_arrays(F.array(F.lit("filePath"), F.lit("line")), F.array(F.col("file_path"), F.col("line").cast("string")))
    more = F.map_filter(F.coalesce("property_map", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin("filePath", "line"))
    return edges.select("source_id", "target_id", "type", F.to_json(F.map_concat(own, more)).alias("properties"))


def json_result(df: DataFrame) -> DataFrame:
    """(json): each row as one JSON object."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def not_exported(nodes: DataFrame) -> DataFrame:
    """Rows whose metadata doesn't say that they are exported."""
    return nodes.where(~F.coalesce(F.get_json_object("metadata", "$.exported") == "true", F.lit(False)))
