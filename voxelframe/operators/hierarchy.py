"""Plates, rows, wells and positions as tables, and the changes made to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.functions.names import natural_key
from voxelframe.operators.windows import first_source

#: Attribute keys that belong to the format, not to users.
RESERVED_KEYS = ("ome", "multiscales", "omero", "labels", "version")


def positions(rows: DataFrame, wells: DataFrame, fields: DataFrame) -> DataFrame:
    """Path of every position. rows (row_id, row), wells (well_id, row_id, column), fields (well_id, field)."""
    joined = fields.join(wells, "well_id").join(rows, "row_id")
    return joined.select("row", "column", "field", F.concat_ws("/", "row", "column", "field").alias("path"))


def nodes(paths: DataFrame) -> DataFrame:
    """Every node on the way to each position: path, parent, name, depth."""
    parts = F.split("path", "/")
    all_prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    each = paths.select(F.explode(all_prefixes).alias("path")).distinct()
    depth = F.size(F.split("path", "/"))
    return each.select(
        "path",
        F.when(depth > 1, F.regexp_replace("path", "/[^/]*$", "")).otherwise("").alias("parent"),
        F.regexp_extract("path", "[^/]*$", 0).alias("name"),
        depth.cast("long").alias("depth"),
    )


def tree(nodes: DataFrame, level: int | None = None) -> DataFrame:
    """Nodes down to a depth, with a sort key by which siblings come in natural order below their parent."""
    shown = nodes if level is None else nodes.filter(F.col("depth") <= level)
    return shown.withColumn("order", F.transform(F.split("path", "/"), natural_key))


def create_or_append(existing: DataFrame, wanted: DataFrame, keys: list[str], names: str) -> DataFrame:
    """Items of an ordered list (keys, ``names``, ``index``): those there keep their index, wanted ones that are missing follow.

    Repeated wanted items count once; new ones come in the order of their name.
    """
    new = missing(wanted.select(*keys, names).distinct(), existing, [*keys, names])
    top = existing.groupBy(*keys).agg((F.max("index") + 1).alias("__next"))
    w = Window.partitionBy(*keys).orderBy(names)
    numbered = new.withColumn("__n", F.row_number().over(w) - 1).join(top, keys, "left")
    return existing.select(*keys, names, "index").unionByName(numbered.select(*keys, names, (F.coalesce("__next", F.lit(0)) + F.col("__n")).cast("long").alias("index")))


def leaves(nodes: DataFrame) -> DataFrame:
    """Nodes without children."""
    return nodes.join(nodes.select(F.col("parent").alias("path")).distinct(), "path", "left_anti")


def children(nodes: DataFrame) -> DataFrame:
    """Sorted child names of every node that has any, the root under the empty path."""
    return nodes.groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("n_children"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("children"))


def lookup(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.filter(F.col("path") == path.strip("/"))


def contains(existing: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``wanted`` with ``present``: whether its key is among the existing ones."""
    there = existing.select(*keys).distinct().withColumn("present", F.lit(True))
    return wanted.join(there, keys, "left").withColumn("present", F.coalesce("present", F.lit(False)))


def delete(nodes: DataFrame, path: str) -> DataFrame:
    """Without a node and all below it."""
    return nodes.filter((F.col("path") != path) & ~F.startswith("path", F.lit(path + "/")))


def first_position(paths: DataFrame, keys: list[str]) -> DataFrame:
    """The first position of each key by the metadata's order (``ordinal``)."""
    return paths.groupBy(*keys).agg(F.min_by("path", "ordinal").alias("path"))


def summary(paths: DataFrame, keys: list[str]) -> DataFrame:
    """Wells, positions and bytes of each key."""
    return paths.groupBy(*keys).agg(F.count_distinct("row", "column").alias("n_wells"), F.count("*").alias("n_positions"), F.sum("nbytes").alias("nbytes"))


def missing(wanted: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """What is wanted and isn't there yet (positions to create, channels to append)."""
    return wanted.join(existing, keys, "left_anti")


def next_index(items: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The index a wanted name has, or else the one after the largest; new names count up in their order."""
    top = items.groupBy(*keys).agg(F.max("index").alias("top"))
    own = wanted.join(items, [*keys, "name"], "left").join(top, keys, "left")
    w = Window.partitionBy(*keys, F.col("index").isNull()).orderBy("name")
    return own.select(*keys, "name", F.coalesce("index", F.coalesce("top", F.lit(-1)) + F.row_number().over(w)).cast("long").alias("index"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once: rows here break a uniqueness rule."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def metadata_to_write(sources: DataFrame, existing: DataFrame) -> DataFrame:
    """The first source's value of each position and key, unless the destination has one.

    sources (position, key, value, source), existing (position, key).
    """
    free = sources.filter(~F.col("key").isin(*RESERVED_KEYS))
    return first_source(free, ["position", "key"], "source").join(existing, ["position", "key"], "left_anti")


def rename_wells(wells: DataFrame, mapping: DataFrame) -> DataFrame:
    """Wells (path) renamed by a mapping (old, new); others stay. Collisions raise when they are read."""
    moved = wells.join(mapping, F.col("path") == F.col("old"), "left").select(F.col("path").alias("old_path"), F.coalesce("new", "path").alias("path"))
    n = F.count("*").over(Window.partitionBy("path"))
    return moved.withColumn("path", F.when(n > 1, F.raise_error(F.concat(F.lit("two wells would be "), "path"))).otherwise(F.col("path")))


def _ordered(name: str) -> Column:
    """The distinct values of a group in natural order."""
    keyed = F.array_sort(F.collect_set(F.struct(natural_key(F.col(name)).alias("k"), F.col(name).alias("v"))))
    return F.transform(keyed, lambda x: x["v"])


def _wrapped(kind: str, content: Column, version: str) -> Column:
    """Metadata of a group as JSON: the newer format wraps them and has the version beside them, the older has it inside."""
    if version == "0.4":
        return F.to_json(F.struct(content.withField("version", F.lit(version)).alias(kind)))
    return F.to_json(F.struct(F.struct(F.lit(version).alias("version"), content.alias(kind)).alias("ome")))


def well_metadata(positions: DataFrame, version: str = "0.5") -> DataFrame:
    """(row, column, meta): the metadata of each well of positions (row, column, field), its fields in natural order."""
    images = F.transform(_ordered("field"), lambda f: F.struct(f.alias("path")))
    wells = positions.groupBy("row", "column").agg(images.alias("images"))
    return wells.select("row", "column", _wrapped("well", F.struct("images"), version).alias("meta"))


def plate_metadata(positions: DataFrame, keys: list[str], version: str = "0.5", field_count: bool = False) -> DataFrame:
    """(keys, meta): the metadata of each plate of positions: its rows, columns and wells in natural order.

    Wells name their row's and column's places in those lists. With ``field_count`` the largest
    number of fields of a well is told too. A plate's wells meet in one row, as its metadata are
    one document.
    """
    wells = positions.groupBy(*keys, "row", "column").agg(F.count_distinct("field").alias("n"))
    well = F.array_sort(F.collect_list(F.struct(natural_key(F.col("row")).alias("a"), natural_key(F.col("column")).alias("b"), "row", "column")))
    one = wells.groupBy(*keys).agg(_ordered("row").alias("rows"), _ordered("column").alias("columns"), well.alias("wells"), F.max("n").alias("n"))
    named = lambda c: F.transform(c, lambda n: F.struct(n.alias("name")))
    at = lambda c, v: (F.array_position(F.col(c), v) - 1).cast("int")
    listed = F.transform("wells", lambda w: F.struct(F.concat_ws("/", w["row"], w["column"]).alias("path"), at("rows", w["row"]).alias("rowIndex"), at("columns", w["column"]).alias("columnIndex")))
    parts = [named("rows").alias("rows"), named("columns").alias("columns"), listed.alias("wells"), *([F.col("n").alias("field_count")] if field_count else [])]
    return one.select(*keys, _wrapped("plate", F.struct(*parts), version).alias("meta"))


def layout(keys: Column) -> Column:
    """What a group of metadata keys describes: plate before a numbered series before a single image."""
    return F.when(F.array_contains(keys, "plate"), "hcs").when(F.array_contains(keys, "bioformats2raw.layout"), "bf2raw").when(F.array_contains(keys, "multiscales"), "fov")


def version(ome_version: Column, flat_version: Column) -> Column:
    """The nested version, else the flat one, else 0.4."""
    return F.coalesce(ome_version, flat_version, F.lit("0.4"))
