"""What a path or an acquisition's axes tell about its format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.functions import names
from voxelframe.sources import acquisitions, stores


def infer_format(path: Column, has_index: Column) -> Column:
    """Format of a file or folder by its name; ``has_index`` says whether an acquisition index lies in it."""
    low = F.lower(path)
    return (
        F.when(low.rlike(r"\.nd2$"), "nd2")
        .when(low.rlike(r"\.ozx$"), "archive")
        .when(F.contains(low, F.lit(".zarr")), "zarr")
        .when(has_index, "ndtiff")
        .when(low.rlike(r"\.ome\.tiff?$"), "ome-tiff")
        .when(low.rlike(r"\.tiff?$"), "single-page-tiff")
    )


def listing(spark: SparkSession, *paths: str) -> DataFrame:
    """(root, path, bytes) of every file below each path, or of the path itself; contents aren't read.

    Spark passes over files with a leading dot, so a store's own ones are asked for at its top.
    """
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    out, dotted = None, []
    for root in paths:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        own = files.select(F.lit(root).alias("root"), "path", F.col("length").alias("bytes"))
        out = own if out is None else out.unionByName(own)
        system = hadoop.Path(root).getFileSystem(conf)
        found = [hadoop.Path(f"{root}/{name}") for name in (".zgroup", ".zattrs")]
        dotted += [(root, f.toString(), system.getFileStatus(f).getLen()) for f in found if system.exists(f)]
    return out.unionByName(spark.createDataFrame(dotted, "root string, path string, bytes long"))


def infer_from_files(files: DataFrame) -> DataFrame:
    """(root, format): what each root is, by the names of the files in it (root, path).

    A file is what its name says. A folder is a store where metadata of groups lie at its top or its
    name says so; an acquisition with an index file, of volumes (index and metadata lines of
    channels), or of images, of which those with metadata inside come first. Null for none.
    """
    # What follows the root, whatever scheme stands before either.
    plain = lambda c: F.regexp_replace(c, "^[a-zA-Z][a-zA-Z0-9+.-]*:/*", "/")
    inside = F.regexp_replace(F.substr(plain("path"), F.length(plain("root")) + 1), "^/+", "")
    name = F.lower(F.regexp_extract(inside, "[^/]*$", 0))
    top = ~F.contains(inside, F.lit("/"))
    rows = files.select("root", name.alias("name"), top.alias("top"), (inside == "").alias("itself"))
    has = lambda pattern, where=F.lit(True): F.max(where & F.col("name").rlike(pattern))
    one = rows.groupBy("root").agg(
        F.max("itself").alias("file"),
        has(r"^(zarr\.json|\.zgroup|\.zattrs)$", F.col("top")).alias("store"),
        has(r"^ndtiff\.index$", F.col("top")).alias("indexed"),
        has(r"\.index\.txt$", F.col("top")).alias("volumes"),
        has(r"\.ome\.tiff?$").alias("ome"),
        has(r"\.tiff?$").alias("tiff"),
    )
    named = infer_format(F.col("root"), F.col("indexed"))
    found = (
        F.when(F.col("file"), named)
        .when(F.col("store") | F.contains(F.lower("root"), F.lit(".zarr")), "zarr")
        .when(F.col("indexed"), "ndtiff")
        .when(F.col("volumes"), "clearcontrol")
        .when(F.col("ome"), "ome-tiff")
        .when(F.col("tiff"), "single-page-tiff")
    )
    return one.select("root", found.alias("format"))


def reader(path: Column, has_index: Column, kind: Column) -> Column:
    """The reader that opens a path: of the kind asked for, else of the format that it is; no such format raises.

    A kind that the path's name contradicts raises too.
    """
    found = infer_format(path, has_index)
    unknown = F.raise_error(F.concat(F.lit("no reader for "), path)).cast("string")
    other = F.raise_error(F.concat(path, F.lit(" isn't "), kind)).cast("string")
    return F.when(kind.isNotNull() & found.isNotNull() & (kind != found), other).otherwise(F.coalesce(kind, found, unknown))


def read_images(spark: SparkSession, path: str, kind: str | None = None) -> tuple[str, dict[str, DataFrame]]:
    """The format of a path, by what lies there unless it is given, and its tables.

    Stores have ``nodes`` (metadata of all groups and arrays); volumes with index lines have
    ``shape`` and ``metadata``. Formats whose pixels need a vendor's codec are named, not read.
    """
    known = kind or infer_from_files(listing(spark, path)).first()["format"]
    if known is None:
        raise ValueError(f"no reader for {path}")
    if known == "zarr":
        return known, {"nodes": stores.open_store(spark, path)[2]}
    if known == "clearcontrol":
        return known, {"shape": acquisitions.shape(acquisitions.index_lines(spark, path)), "metadata": acquisitions.metadata_lines(spark, path)}
    raise NotImplementedError(f"{known} files need a codec that this library leaves out")


def may_overwrite(path: Column) -> Column:
    """Only paths that are named like stores may be replaced."""
    return F.contains(path, F.lit(".zarr")) | path.rlike(r"\.ozx$")


def series(listed: Column, in_folder: Column, groups: Column) -> Column:
    """Series of a numbered collection: as listed, else as its folder lists them, else its numeric groups; natural order."""
    numeric = F.filter(groups, lambda g: g.rlike(r"^\d+$"))
    chosen = F.coalesce(listed, in_folder, numeric)
    keyed = F.transform(chosen, lambda s: F.struct(names.natural_key(s).alias("k"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def resolve_axis(asked: Column, known: Column) -> Column:
    """A coordinate on an axis with the ``known`` values (null: no such axis).

    On an absent axis 0 means nothing to select; on an axis of names 0 means the first; any other
    unknown coordinate raises.
    """
    return (
        F.when(known.isNull() & (asked == "0"), F.lit(None).cast("string"))
        .when(F.array_contains(known, asked), asked)
        .when(known.isNotNull() & (asked == "0"), F.try_element_at(known, F.lit(1)))
        .otherwise(F.raise_error(F.concat(F.lit("no such coordinate: "), asked)).cast("string"))
    )


def voxel_size(size: Column) -> Column:
    """A size that is missing or zero counts as 1."""
    return F.coalesce(F.nullif(size, F.lit(0.0)), F.lit(1.0))


def with_missing_volumes(volumes: DataFrame, expected: DataFrame, keys: list[str], value) -> DataFrame:
    """Volumes that were planned and never written, at a constant value; ``missing`` tells them."""
    return expected.join(volumes, keys, "left").select(*keys, F.coalesce("value", F.lit(value)).alias("value"), F.col("value").isNull().alias("missing"))
