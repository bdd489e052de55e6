"""Entries of packed stores as a table: order, last entries, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.operators.windows import last_entries


def pack_order(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Metadata files first, by depth and name, then all others in their order; adds ``position``."""
    depth = F.size(F.split("name", "/"))
    meta = F.col("name").rlike(r"(^|/)zarr\.json$")
    order = Window.partitionBy(*keys).orderBy(meta.cast("int").desc(), F.when(meta, depth), F.when(meta, F.col("name")), "ordinal")
    return entries.withColumn("position", (F.row_number().over(order) - 1).cast("long"))


def unpack(entries: DataFrame, keys: list[str]) -> DataFrame:
    """The last entry of each name, without folders; a name that leads out of the archive raises when it is read."""
    slashed = F.translate("name", "\\", "/")
    outside = F.startswith(slashed, F.lit("/")) | F.array_contains(F.split(slashed, "/"), "..") | slashed.rlike("^[A-Za-z]:")
    checked = F.when(outside, F.raise_error(F.concat(F.lit("unsafe name in archive: "), "name"))).otherwise(F.col("name"))
    files = entries.withColumn("name", checked).filter(~F.endswith("name", F.lit("/")))
    return last_entries(files, [*keys, "name"], ["ordinal"])


def comment_fields(comment: Column) -> Column:
    """struct(version, json_first) of an archive's comment; nulls where it is no such comment."""
    parsed = F.from_json(comment, "ome struct<version: string, zipFile: struct<centralDirectory: struct<jsonFirst: boolean>>>")
    return F.struct(parsed["ome"]["version"].alias("version"), parsed["ome"]["zipFile"]["centralDirectory"]["jsonFirst"].alias("json_first"))


def summary(entries: DataFrame, keys: list[str]) -> DataFrame:
    return entries.groupBy(*keys).agg(
        F.count("*").alias("n_entries"),
        F.count_if(F.col("name").rlike(r"(^|/)zarr\.json$")).alias("n_metadata"),
        (F.count("*") - F.count_distinct("name")).alias("n_duplicates"),
    )
