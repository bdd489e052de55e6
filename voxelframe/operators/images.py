"""Image records: levels, channels, labels, side metadata and the life of units of work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.functions import names
from voxelframe.operators.hierarchy import RESERVED_KEYS
from voxelframe.operators.windows import ordinals

# Metadata versions and the storage formats that belong to them.
STORAGE_FORMAT = {"0.4": 2, "0.5": 3}


def storage_format(version: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in STORAGE_FORMAT.items() for x in pair]), version)


def valid_children(nodes: DataFrame, parent: Column) -> DataFrame:
    """Children whose metadata could be read (``meta`` isn't null), in natural order; broken ones are passed over."""
    return nodes.filter((F.col("parent") == parent) & F.col("meta").isNotNull()).orderBy(names.natural_key(F.col("name")))


def add_level(levels: DataFrame, images: DataFrame) -> DataFrame:
    """One more level for each image: the first creates its record, later ones follow the last."""
    last = levels.groupBy("image").agg(F.max("level").alias("last"))
    new = images.join(last, "image", "left").select("image", (F.coalesce("last", F.lit(-1)) + 1).alias("level"))
    return levels.select("image", "level").unionByName(new)


def label_names(labels: DataFrame) -> DataFrame:
    """Sorted label names of each image and whether it has any."""
    return labels.groupBy("image").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), (F.count("label") > 0).alias("has_labels"))


def create_label(cells: DataFrame, condition: Column) -> DataFrame:
    """A label image of the cells' shape: 1 where the condition holds, else 0. Labels are whole numbers."""
    return cells.withColumn("value", F.when(condition, F.lit(1)).otherwise(F.lit(0)).cast("long"))


def display_settings(channels: DataFrame) -> DataFrame:
    """Colour and window of each channel; an image's first channel is active."""
    first = F.row_number().over(Window.partitionBy("image").orderBy("ordinal")) == 1
    window = names.display_window(F.col("name"))
    return channels.select("image", "name", names.channel_color(F.col("name")).alias("color"), window["start"].alias("start"), window["end"].alias("end"), first.alias("active"))


def set_window(channels: DataFrame, image, name: str, start: float, end: float) -> DataFrame:
    """Replace a channel's display window: start and end are set, the range (min, max) stays."""
    hit = (F.col("image") == image) & (F.col("name") == name)
    kept = F.struct(F.lit(float(start)).alias("start"), F.lit(float(end)).alias("end"), F.col("window.min").alias("min"), F.col("window.max").alias("max"))
    return channels.withColumn("window", F.when(hit, kept).otherwise(F.col("window")))


def rename_channel(channels: DataFrame, old: str, new: str) -> DataFrame:
    """Rename a channel in the list; a name that is there already raises when it is read."""
    taken = channels.filter(F.col("name") == new).select("image").distinct().withColumn("__taken", F.lit(True))
    name = F.when(F.col("__taken"), F.raise_error(F.lit(f"there is a channel {new} already"))).otherwise(F.lit(new))
    return channels.join(taken, "image", "left").withColumn("name", F.when(F.col("name") == old, name).otherwise(F.col("name"))).drop("__taken")


def channel_index(channels: DataFrame, wanted: DataFrame) -> DataFrame:
    """The index of each wanted channel (image, name); one that isn't there raises when it is read."""
    absent = F.raise_error(F.concat(F.lit("no such channel: "), "name")).cast("long")
    return wanted.join(channels.select("image", "name", "index"), ["image", "name"], "left").withColumn("index", F.coalesce("index", absent))


def label(labels: DataFrame, name: str) -> DataFrame:
    """The label images of one name."""
    return labels.filter(F.col("label") == name)


def pair_sites(positions: DataFrame, fields: DataFrame, position_order: list[str], field_order: list[str]) -> DataFrame:
    """Positions and fields paired by their place in their own order; where one has more than the other, reading raises."""
    a, b = ordinals(positions, position_order, "__n"), ordinals(fields, field_order, "__n")
    both = a.withColumn("__a", F.lit(True)).join(b.withColumn("__b", F.lit(True)), "__n", "full_outer")
    alone = F.raise_error(F.concat(F.lit("no partner for site "), F.col("__n").cast("string"))).cast("boolean")
    return both.filter(F.when(F.col("__a") & F.col("__b"), F.lit(True)).otherwise(alone)).drop("__n", "__a", "__b")


def frame_metadata(planes: DataFrame, metadata: DataFrame, keys: list[str]) -> DataFrame:
    """Every plane with its metadata row; nulls where an acquisition wrote none."""
    return planes.join(metadata, keys, "left")


def parted(lines: DataFrame, text: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Lines of JSON as two tables: those that can be read, as ``metadata``, and the broken ones as they are.

    A line is broken where it is no whole JSON object or a field isn't of its type. An acquisition
    that crashed leaves such lines; they are kept for a look, and don't stop the others.
    """
    row = F.from_json(F.col(text), f"{schema}, __broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__broken"})
    known = lines.withColumn("__row", row)
    broken = F.coalesce(F.col("__row.__broken").isNotNull(), F.lit(True)) | F.col("__row").isNull()
    return known.filter(~broken).withColumn("metadata", F.col("__row").dropFields("__broken")).drop("__row", text), known.filter(broken).drop("__row")


def refused_keys(attributes: DataFrame, key: str) -> DataFrame:
    """Attributes whose key belongs to the format: rows here can't be written as users' own."""
    return attributes.filter(F.col(key).isin(*RESERVED_KEYS))


def equal_fields(one: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Fields that are the same in two stores: those whose root and key are in both."""
    return one.select(*keys).intersect(other.select(*keys))


def merge_attributes(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Attributes (image, key, value) with new ones over old; a key that belongs to the format raises when it is read."""
    refused = F.raise_error(F.concat(F.lit("reserved key: "), F.col("key").cast("string")))
    new = new.withColumn("key", F.when(F.col("key").cast("string").isin(*RESERVED_KEYS), refused.cast(new.schema["key"].dataType)).otherwise(F.col("key")))
    return existing.join(new.select("image", "key"), ["image", "key"], "left_anti").unionByName(new)


def plane_metadata(planes: DataFrame, keys: list[str]) -> DataFrame:
    """One JSON text per image: planes named t/c/z, keys with a dash after the others."""
    ordered = sorted(keys, key=lambda k: ("-" in k, k))  # as names.plane_key
    name = F.concat_ws("/", F.col("t").cast("string"), F.col("c").cast("string"), F.col("z").cast("string"))
    entry = F.struct(F.col("t"), F.col("c"), F.col("z"), name.alias("name"), F.to_json(F.struct(*[F.col(k) for k in ordered])).alias("json"))
    parts = F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.concat(F.lit('"'), e["name"], F.lit('":'), e["json"]))
    return planes.groupBy("image").agg(F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")).alias("metadata"))


def unit_states(events: DataFrame) -> DataFrame:
    """The state each unit of work is in after its last event: begun units are in flight, completed ones done."""
    last = events.groupBy("unit").agg(F.max_by("event", "ordinal").alias("event"))
    return last.select("unit", F.when(F.col("event") == "complete", "done").otherwise("in flight").alias("state"))


def progress_path(store: Column) -> Column:
    """Where the ledger of a store stands: beside it, never in it."""
    return F.concat(F.regexp_replace(store, "/+$", ""), F.lit(".progress"))


def report(levels: DataFrame, largest: str | None = None) -> DataFrame:
    """A line of text for each image: shape, type and size of its first level, in units up to ``largest`` (as ``names.size_text``)."""
    base = levels.filter("level = 0")
    size = names.size_text(F.aggregate("shape", F.lit(1).cast("long"), lambda a, n: a * n) * F.col("item"), largest)
    return base.select("image", F.concat(F.array_join(F.transform("shape", lambda n: n.cast("string")), "x"), F.lit(" "), F.col("dtype"), F.lit(" "), size).alias("report"))


def collate(cells: DataFrame, axis: str, names: DataFrame) -> DataFrame:
    """Cells of all positions along an axis, keyed by the position's name (``names``: name, index)."""
    own = names.select(F.col("name").alias("position"), F.col("index").alias(axis))
    return cells.join(own, axis).drop(axis)
