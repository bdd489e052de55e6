"""Text side files of acquisitions: index lines, metadata lines and summaries, read as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelframe.functions.names import index_line

METADATA = "Channel string, TimeStampInNanoSeconds long, AcquisitionType string, VoxelDimX double, VoxelDimY double, VoxelDimZ double"


def index_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of ``<channel>.index.txt`` files: channel, ordinal, line."""
    lines = spark.read.text(f"{path}/*.index.txt").select("value", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("ordinal"))
    return lines.select(F.regexp_extract("file", r"^(.*)\.index\.txt$", 1).alias("channel"), "ordinal", F.col("value").alias("line"))


def shape(lines: DataFrame) -> DataFrame:
    """One row (t, c, z, y, x): the least sizes over channels, from each channel's last line."""
    last = lines.groupBy("channel").agg(F.max_by("line", "ordinal").alias("line"))
    sizes = last.select("channel", index_line(F.col("line")).alias("s")).select("channel", "s.*")
    return sizes.agg((F.min("t") + 1).alias("t"), F.count("*").alias("c"), F.min("z").alias("z"), F.min("y").alias("y"), F.min("x").alias("x"))


def metadata_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of ``*.metadata.txt`` files; broken lines become rows of nulls."""
    rows = spark.read.schema(METADATA).option("mode", "PERMISSIVE").json(f"{path}/*.metadata.txt")
    return rows.withColumn("ordinal", F.monotonically_increasing_id())


def summary(rows: DataFrame) -> DataFrame:
    """Mean voxel sizes, mean time step in milliseconds (over steps within channels), first acquisition type."""
    w = Window.partitionBy("Channel").orderBy("ordinal")
    steps = rows.withColumn("delta", F.col("TimeStampInNanoSeconds") - F.lag("TimeStampInNanoSeconds").over(w))
    return steps.agg(
        F.avg("VoxelDimZ").alias("voxel_size_z"),
        F.avg("VoxelDimY").alias("voxel_size_y"),
        F.avg("VoxelDimX").alias("voxel_size_x"),
        (F.avg("delta") / 1_000_000).alias("time_delta_ms"),
        F.min_by("AcquisitionType", "ordinal").alias("acquisition_type"),
    )


_DEVICE = "array<struct<Device: string, Position_um: array<double>>>"
_STAGE = "array<struct<stageName: string, x: double, y: double, z: double>>"
#: The parts of an acquisition's summary that are used.
SUMMARY = (
    "MicroManagerVersion string, Prefix string, Positions long, Channels long, ChNames array<string>, "
    "Height long, Width long, `z-step_um` double, Interval_ms double"
)


def _summary_fields(df: DataFrame, text: str) -> DataFrame:
    s = F.from_json(F.get_json_object(text, "$.Summary"), SUMMARY)
    return df.withColumn("__s", s).withColumn("__beta", F.contains(F.col("__s.MicroManagerVersion"), F.lit("beta")))


def acquisition_summary(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Version, channel names, size and steps of each acquisition, from its metadata JSON.

    Beta versions without channel names have as many empty ones as channels; others none. A step
    that is missing or 0 counts as 1 (micrometre or second).
    """
    s = _summary_fields(df, text)
    unnamed = F.when(F.col("__beta"), F.array_repeat(F.lit(""), F.coalesce(F.col("__s.Channels"), F.lit(0)).cast("int"))).otherwise(F.array().cast("array<string>"))
    one = lambda c: F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(1.0))
    return s.select(
        *keys,
        F.col("__s.MicroManagerVersion").alias("version"),
        F.coalesce(F.col("__s.ChNames"), unnamed).alias("channels"),
        F.col("__s.Height").alias("height"),
        F.col("__s.Width").alias("width"),
        one(F.col("__s.z-step_um")).alias("z_step"),
        one(F.col("__s.Interval_ms") / 1000).alias("t_step"),
    )


def stage_positions(df: DataFrame, keys: list[str], text: str, sites: str | None = None) -> DataFrame:
    """One row for each position and stage device: keys, position, label, device, values.

    Acquisitions of a single position have none. Beta versions list sub-positions, whose zero
    parts are left out; later ones list devices. ``sites`` names a column with the numbers of
    those positions that were saved, in their order; without it all are.
    """
    s = _summary_fields(df, text).filter(F.coalesce(F.col("__s.Positions"), F.lit(1)) > 1)
    number = F.size(F.from_json(F.get_json_object(text, "$.Summary.StagePositions"), "array<string>"))
    chosen = F.sequence(F.lit(0), number - 1) if sites is None else F.col(sites)
    rows = s.withColumn("__all", F.from_json(F.get_json_object(text, "$.Summary.StagePositions"), "array<string>"))
    rows = rows.select(*keys, "__beta", "__all", F.posexplode(chosen).alias("position", "__site")).withColumn("__text", F.element_at("__all", (F.col("__site") + 1).cast("int")))
    later = F.transform(F.from_json(F.get_json_object("__text", "$.DevicePositions"), _DEVICE), lambda d: F.struct(d["Device"].alias("device"), d["Position_um"].alias("values")))
    parts = lambda d: F.filter(F.array(d["x"], d["y"], d["z"]), lambda v: v != 0)
    beta = F.transform(F.from_json(F.get_json_object("__text", "$.subpositions"), _STAGE), lambda d: F.struct(d["stageName"].alias("device"), parts(d).alias("values")))
    label = F.coalesce(F.get_json_object("__text", "$.Label"), F.get_json_object("__text", "$.label")).alias("label")
    return rows.select(*keys, "position", label, F.inline(F.when(F.col("__beta"), beta).otherwise(later)))
