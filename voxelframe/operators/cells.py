"""Arrays as cell tables: one row per element, one integer column per axis, and ``value``.

Cells that are missing read as the fill value, so tables stay sparse until ``fill_missing``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Index = int | slice | Sequence[int]


def from_rows(df: DataFrame, row: str, array: str, value: Column | None = None) -> DataFrame:
    """A table with one array per row as cells (y, x, value); ``value`` may transform ``F.col("value")``."""
    out = df.select(F.col(row).cast("long").alias("y"), F.posexplode(array).alias("x", "value"))
    return out.select("y", F.col("x").cast("long").alias("x"), (value if value is not None else F.col("value")).alias("value"))


def grid(spark: SparkSession, sizes: Mapping[str, int]) -> DataFrame:
    """Every index of an array: one range, taken apart axis by axis, without a join."""
    total = reduce(lambda a, b: a * b, sizes.values(), 1)
    out, below = spark.range(total), total
    columns = []
    for axis, size in sizes.items():
        below //= max(1, size)
        columns.append(F.floor(F.col("id") / max(1, below)).cast("long") % size if size else F.lit(0))
        columns[-1] = columns[-1].alias(axis)
    return out.select(*columns)


def _bounds(key: slice, size: int) -> tuple[int, int, int]:
    start, stop, step = key.indices(size)
    if step < 1:
        raise ValueError("steps must be positive")
    return start, stop, step


def select(cells: DataFrame, sizes: Mapping[str, int], **keys: Index) -> DataFrame:
    """Basic and orthogonal selection.

    An int takes one index and drops its axis, a slice keeps a range and renumbers it, a list
    keeps its indices in the order asked for, repeated ones repeatedly. Axes not named stay.
    Ints and slices are filters that reach the scan; a list is matched by lookup, not by a join.
    """
    axes = [c for c in cells.columns if c in sizes]
    out = cells
    for axis, key in keys.items():
        size = sizes[axis]
        if isinstance(key, int):
            key = key + size if key < 0 else key
            if not 0 <= key < size:
                raise IndexError(f"index {key} on axis {axis} of size {size}")
            out = out.filter(F.col(axis) == key).drop(axis)
        elif isinstance(key, slice):
            start, stop, step = _bounds(key, size)
            out = out.filter((F.col(axis) >= start) & (F.col(axis) < stop))
            if step > 1:
                out = out.filter((F.col(axis) - start) % step == 0)
            if start or step > 1:
                out = out.withColumn(axis, F.floor((F.col(axis) - start) / step).cast("long"))
        else:
            wanted = [k + size if k < 0 else k for k in key]
            if any(not 0 <= k < size for k in wanted):
                raise IndexError(f"an index on axis {axis} of size {size}")
            places: dict[int, list[int]] = {}
            for at, k in enumerate(wanted):
                places.setdefault(k, []).append(at)
            if not places:
                out = out.filter(F.lit(False))
                continue
            lookup = F.create_map(*[x for k, at in places.items() for x in (F.lit(k).cast("long"), F.array(*[F.lit(p).cast("long") for p in at]))])
            out = out.filter(F.col(axis).isin(list(places))).withColumn(axis, F.explode(F.try_element_at(lookup, F.col(axis))))
    return out.select(*[c for c in [*axes, "value"] if c in out.columns])


def shape_of(cells: DataFrame, axes: Sequence[str]) -> dict[str, int]:
    """Largest index of each axis plus one; 0 for an empty table."""
    top = cells.agg(*[F.coalesce(F.max(a) + 1, F.lit(0)).alias(a) for a in axes]).first()
    return {a: int(top[a]) for a in axes}


def fill_missing(cells: DataFrame, sizes: Mapping[str, int], fill=0) -> DataFrame:
    """A dense table: absent (and null) cells get the fill value."""
    axes = list(sizes)
    full = grid(cells.sparkSession, sizes).join(cells, axes, "left")
    return full.select(*axes, F.coalesce("value", F.lit(fill)).alias("value"))


def resize(cells: DataFrame, old: Mapping[str, int], new: Mapping[str, int], fill=0) -> DataFrame:
    """Shrinking drops cells; growing adds cells of the fill value, the old ones stay sparse or not."""
    kept = cells.filter(reduce(lambda a, b: a & b, [F.col(a) < n for a, n in new.items()], F.lit(True)))
    added = reduce(lambda a, b: a | b, [F.col(a) >= old[a] for a in new], F.lit(False))
    more = grid(cells.sparkSession, new).filter(added).withColumn("value", F.lit(fill).cast(cells.schema["value"].dataType))
    return kept.unionByName(more)


def append(cells: DataFrame, data: DataFrame, axis: str, size: int) -> DataFrame:
    """``data`` after the array's ``size`` indices on one axis."""
    return cells.unionByName(data.withColumn(axis, F.col(axis) + size))


def overwrite(cells: DataFrame, data: DataFrame, axes: Sequence[str], where: Column) -> DataFrame:
    """Replace the region ``where`` by ``data``, whose cells outside it are an error of the caller."""
    return cells.filter(~where).select(*axes, "value").unionByName(data.select(*axes, "value"))


def tile_grid(sizes: Mapping[str, int], tile: Mapping[str, int]) -> dict[str, int]:
    """Whole tiles on each axis; partial ones at the edge aren't counted."""
    return {a: sizes[a] // tile[a] for a in tile}


def tile_region(row: int, column: int, tile: tuple[int, int], sizes: Mapping[str, int]) -> Column:
    """The cells of a tile; row and column must lie in the grid."""
    rows, columns = sizes["y"] // tile[0], sizes["x"] // tile[1]
    if not (0 <= row < rows and 0 <= column < columns):
        raise IndexError(f"tile ({row}, {column}) of a grid of {rows} by {columns}")
    y, x = F.col("y"), F.col("x")
    return (y >= row * tile[0]) & (y < (row + 1) * tile[0]) & (x >= column * tile[1]) & (x < (column + 1) * tile[1])


def read_tile(cells: DataFrame, row: int, column: int, tile: tuple[int, int], sizes: Mapping[str, int], **others: Index) -> DataFrame:
    """The cells of one tile, numbered within it; ``others`` choose on the axes before it, as in ``select``."""
    out = (select(cells, sizes, **others) if others else cells).filter(tile_region(row, column, tile, sizes))
    return out.withColumn("y", F.col("y") - row * tile[0]).withColumn("x", F.col("x") - column * tile[1])


def write_tile(cells: DataFrame, data: DataFrame, row: int, column: int, tile: tuple[int, int], sizes: Mapping[str, int], **others: int) -> DataFrame:
    """Cells with one tile replaced by ``data`` (y, x, value); ``others`` say where on the axes before it."""
    moved = data.withColumn("y", F.col("y") + row * tile[0]).withColumn("x", F.col("x") + column * tile[1])
    where = tile_region(row, column, tile, sizes)
    for axis, k in others.items():
        if not 0 <= k < sizes[axis]:
            raise IndexError(f"index {k} on axis {axis} of size {sizes[axis]}")
        moved, where = moved.withColumn(axis, F.lit(k).cast("long")), where & (F.col(axis) == k)
    return overwrite(cells, moved, [*others, "y", "x"], where)


def make_tiles(cells: DataFrame, tile: tuple[int, int]) -> DataFrame:
    """Number each cell's tile and its place in it."""
    y, x = F.col("y"), F.col("x")
    return cells.select(
        F.floor(y / tile[0]).cast("long").alias("tile_row"),
        F.floor(x / tile[1]).cast("long").alias("tile_column"),
        (y % tile[0]).alias("y"),
        (x % tile[1]).alias("x"),
        "value",
    )


def join_tiles(tiles: DataFrame, grid: tuple[int, int], tile: tuple[int, int]) -> tuple[DataFrame, dict[str, int]]:
    """The image that a grid of tiles makes, from cells numbered as by ``make_tiles``, and its sizes; a tile outside the grid raises."""
    inside = (F.col("tile_row") < grid[0]) & (F.col("tile_column") < grid[1]) & (F.col("y") < tile[0]) & (F.col("x") < tile[1])
    outside = F.raise_error(F.concat(F.lit("a cell outside the grid, of tile "), F.concat_ws("/", F.col("tile_row").cast("string"), F.col("tile_column").cast("string")))).cast("boolean")
    rows = tiles.filter(F.when(inside, F.lit(True)).otherwise(outside))
    cells = rows.select((F.col("tile_row") * tile[0] + F.col("y")).alias("y"), (F.col("tile_column") * tile[1] + F.col("x")).alias("x"), "value")
    return cells, {"y": grid[0] * tile[0], "x": grid[1] * tile[1]}


def drop_empty(cells: DataFrame, block: Sequence[str], channel: str) -> DataFrame:
    """Blocks of which no channel is all zero or all NaN; a mixture of the two isn't empty."""
    floating = cells.schema["value"].dataType.typeName() in ("float", "double")
    nan = F.isnan("value") if floating else F.lit(False)
    by_channel = cells.groupBy(*block, channel).agg(F.bool_and(F.col("value") == 0).alias("zero"), F.bool_and(nan).alias("nan"))
    empty = by_channel.filter("zero or nan").select(*block).distinct()
    return cells.join(empty, list(block), "left_anti")


def project(cells: DataFrame, axis: str, how: str = "max") -> DataFrame:
    """Reduce one axis away by max, min, sum or avg."""
    rest = [c for c in cells.columns if c not in (axis, "value")]
    return cells.groupBy(*rest).agg(getattr(F, how)("value").alias("value"))


def dense(cells: DataFrame, sizes: Mapping[str, int], fill=0):
    """A NumPy array on the driver, for arrays that fit there."""
    import numpy as np

    axes = list(sizes)
    table = cells.select(*axes, "value").toArrow()
    value = table["value"].to_numpy()
    out = np.full([sizes[a] for a in axes], fill, dtype=value.dtype if len(value) else float)
    out[tuple(table[a].to_numpy() for a in axes)] = value
    return out
