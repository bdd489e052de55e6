"""Array tables on disk: chunk rows in Parquet, read with pruning by chunk index.

A chunk row holds the chunk's index on each axis and its cells in row-major order; data are
partitioned by shard, so a selection reads only the folders and row groups it touches.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.operators.chunks import element, extents, lists, shard_name, with_range


def to_chunks(cells: DataFrame, sizes: Mapping[str, int], chunk: Mapping[str, int], shard: Mapping[str, int] | None = None, fill=0) -> DataFrame:
    """Cells as chunk rows: ``<axis>_chunk``, ``shard``, ``shape``, ``values``. Chunks of the fill value alone aren't kept.

    A cell outside the array, or one given twice, is an error; null reads as the fill value.
    Cells are gathered by chunk in each Arrow batch, so that what is shuffled is a row for each
    batch and chunk, and are put to their places in one step: time is linear in cells.
    """
    axes = list(sizes)
    width, size = [chunk[a] for a in axes], [sizes[a] for a in axes]
    keys = [f"{a}_chunk" for a in axes]
    held = cells.filter(F.col("value") != fill)
    kind, arrow = element(held.select(F.array("value").alias("values")))
    index = ", ".join(f"{k} long" for k in keys)
    counts = [-(-n // w) for n, w in zip(size, width, strict=True)]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            number, place = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for a, w, n, c in zip(axes, width, size, counts, strict=True):
                at = np.asarray(batch.column(a))
                if at.min() < 0 or at.max() >= n:
                    raise ValueError(f"a cell outside axis {a} of size {n}")
                number = number * c + at // w
                place = place * np.minimum(w, n - at // w * w) + at % w
            order = np.argsort(number, kind="stable")
            own, first = np.unique(number[order], return_index=True)
            ends = pa.array(np.append(first, batch.num_rows).astype(np.int32))
            at = np.unravel_index(own, counts)
            values = pa.ListArray.from_arrays(ends, batch.column("value").take(pa.array(order)))
            yield pa.RecordBatch.from_arrays([*(pa.array(k) for k in at), pa.ListArray.from_arrays(ends, pa.array(place[order].astype(np.int32))), values], [*keys, "places", "values"])

    def scatter(key: tuple, table: pa.Table) -> pa.Table:
        at = [k.as_py() for k in key]
        shape = extents(at, width, size)
        place = np.asarray(table["places"].combine_chunks().flatten())
        values = table["values"].combine_chunks().flatten()
        source = np.full(int(np.prod(shape)), -1, dtype=np.int64)
        source[place] = np.arange(len(place))
        if np.count_nonzero(source >= 0) < len(place):
            raise ValueError(f"a cell of chunk {at} is given twice")
        dense = pc.fill_null(values.take(pa.array(source, mask=source < 0)), pa.scalar(fill).cast(values.type))
        whole = pa.ListArray.from_arrays(pa.array([0, len(dense)], pa.int32()), dense)
        return pa.table([*(pa.array([k], pa.int64()) for k in at), lists([np.array(shape)], pa.int32()), whole], [*keys, "shape", "values"])

    gathered = held.select(*axes, "value").mapInArrow(gather, f"{index}, places array<int>, values array<{kind}>")
    # A chunk is bounded by its shape, so its cells may meet in one task.
    made = gathered.groupBy(*keys).applyInArrow(scatter, f"{index}, shape array<int>, values array<{kind}>")
    return made.select(*keys, shard_name(keys, {a: chunk[a] for a in axes}, shard).alias("shard"), "shape", "values")


def to_cells(chunks: DataFrame, chunk: Mapping[str, int]) -> DataFrame:
    """Chunk rows as cells."""
    axes = list(chunk)
    rows = chunks.select(*[f"{a}_chunk" for a in axes], "shape", F.posexplode("values").alias("place", "value"))
    left, out = F.col("place"), {}
    for k in range(len(axes) - 1, -1, -1):
        extent = F.element_at("shape", k + 1)
        out[axes[k]] = (F.col(f"{axes[k]}_chunk") * chunk[axes[k]] + left % extent).cast("long").alias(axes[k])
        left = F.floor(left / extent)
    return rows.select(*[out[a] for a in axes], "value")


#: Ways to open a store, and what writing to it does.
MODES = {"r+": "append", "a": "append", "w": "overwrite", "w-": "errorifexists"}


def write(chunks: DataFrame, path: str, mode: str = "w-") -> None:
    """Write chunk rows to a store opened by ``mode`` (``r+``, ``a``, ``w``, ``w-``).

    Only what is named like a store may be replaced: its path holds ``.zarr`` or ends in ``.ozx``;
    at any other path ``w`` is ``w-``.
    Rows are dealt by shard and chunk, so a shard is as many tasks' work as its chunks need.
    """
    if mode not in MODES:
        raise ValueError(f"a store can't be written in mode {mode!r}")
    store = ".zarr" in path or path.endswith(".ozx")
    how = MODES[mode] if store or mode != "w" else MODES["w-"]
    keys = [c for c in chunks.columns if c.endswith("_chunk")]
    chunks.repartitionByRange("shard", *keys).sortWithinPartitions("shard", *keys).write.mode(how).partitionBy("shard").parquet(path)


def create_zeros(levels: DataFrame, images: DataFrame, scale: Sequence[float]) -> DataFrame:
    """Level records with one more for each image (image, shape, dtype): metadata only, as chunks that aren't there read as fill.

    An image that has levels takes shapes of as many axes only; others raise when they are read.
    """
    last = levels.groupBy("image").agg(F.max("level").alias("last"), F.first(F.size("shape")).alias("rank"))
    rank = F.coalesce("rank", F.lit(len(scale)))
    bad = F.raise_error(F.concat(F.lit("a shape has another number of axes than the image: "), F.col("image").cast("string"))).cast("array<bigint>")
    fine = (F.size("shape") == rank) & F.forall("shape", lambda n: n > 0)
    new = images.join(last, "image", "left").select(
        "image",
        (F.coalesce("last", F.lit(-1)) + 1).cast("long").alias("level"),
        F.when(fine, F.col("shape").cast("array<bigint>")).otherwise(bad).alias("shape"),
        "dtype",
        F.lit([float(s) for s in scale]).alias("scale"),
    )
    return levels.select("image", "level", "shape", "dtype", "scale").unionByName(new)


def create_image(levels: DataFrame, path: str, image: str, cells: DataFrame, sizes: Mapping[str, int], chunk: Mapping[str, int], scale: Sequence[float], dtype: str, shard: Mapping[str, int] | None = None, mode: str = "w-") -> DataFrame:
    """Write an image's next level and return the level records with its own (image, level, shape, dtype, scale).

    Chunks hold their ranges of values, larger ones than the array are cut to it, and the scale has
    a number above 0 for each axis. Data that don't fit the sizes raise while they are written, and
    an image that has levels of another number of axes when the records are read.
    """
    if len(scale) != len(sizes) or any(s <= 0 for s in scale):
        raise ValueError(f"a scale of {list(scale)} for axes {list(sizes)}")
    if set(chunk) != set(sizes) or any(n < 1 for n in [*chunk.values(), *sizes.values()]):
        raise ValueError(f"chunks of {dict(chunk)} for sizes {dict(sizes)}")
    spark = cells.sparkSession
    fitting = {a: min(chunk[a], sizes[a]) for a in sizes}
    level = levels.filter(F.col("image") == image).count()
    write(with_range(to_chunks(cells, sizes, fitting, shard)), f"{path}/image={image}/level={level}", mode)
    return create_zeros(levels, spark.createDataFrame([(image, list(sizes.values()), dtype)], "image string, shape array<bigint>, dtype string"), scale)


def read(spark: SparkSession, path: str, chunk: Mapping[str, int], region: Mapping[str, tuple[int, int]] | None = None) -> DataFrame:
    """Cells of an array, or of a region of it (start and stop by axis).

    The region becomes filters on chunk indices, which reach the scan, before chunks are opened.
    """
    chunks = spark.read.parquet(path)
    for a, (start, stop) in (region or {}).items():
        chunks = chunks.filter((F.col(f"{a}_chunk") >= start // chunk[a]) & (F.col(f"{a}_chunk") <= (stop - 1) // chunk[a]))
    cells = to_cells(chunks, chunk)
    for a, (start, stop) in (region or {}).items():
        cells = cells.filter((F.col(a) >= start) & (F.col(a) < stop))
    return cells
