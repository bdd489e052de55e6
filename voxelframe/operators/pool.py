"""Block pooling and resolution pyramids."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.operators.cells import grid

METHODS = ("mean", "median", "min", "max", "mode", "stride")


def _weight(factors: Mapping[str, int], sizes: Mapping[str, int]) -> Column:
    """How often a cell counts once its axis is padded with its edge to a multiple of the factor."""
    parts = [F.when(F.col(a) == sizes[a] - 1, F.lit(1 + -sizes[a] % f)).otherwise(F.lit(1)) for a, f in factors.items() if sizes[a] % f]
    return reduce(lambda x, y: x * y, parts, F.lit(1))


def pool(cells: DataFrame, factors: Mapping[str, int], sizes: Mapping[str, int], method: str = "mean") -> DataFrame:
    """Reduce blocks of ``factors`` cells to one; the result keeps the value's type.

    Sizes that aren't a multiple are padded with the edge, as weights: no cell is copied. Whole
    numbers are cut towards zero. NaN in a block makes its mean, median, min and max NaN. Mode
    takes the smallest of equally frequent values; stride takes each block's first cell. Mean,
    min, max and mode combine before the shuffle; median holds a block's values together.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    kind = cells.schema["value"].dataType
    floating = kind.typeName() in ("float", "double")
    axes = [c for c in cells.columns if c != "value"]
    if method == "stride":
        first = reduce(lambda a, b: a & b, [F.col(a) % f == 0 for a, f in factors.items()], F.lit(True))
        return cells.filter(first).select(*[F.floor(F.col(a) / factors[a]).cast("long").alias(a) if a in factors else F.col(a) for a in axes], "value")
    target = [F.floor(F.col(a) / factors[a]).cast("long").alias(a) if a in factors else F.col(a) for a in axes]
    rows = cells.select(*target, "value", _weight(factors, sizes).cast("long").alias("w"))
    if method == "mode":
        counts = rows.groupBy(*axes, "value").agg(F.sum("w").alias("n"))
        order = F.struct(-F.col("n"), F.col("value"))
        return counts.groupBy(*axes).agg(F.min_by("value", order).alias("value"))
    made = {
        "mean": lambda: F.sum(F.col("value") * F.col("w")) / F.sum("w"),
        "median": lambda: F.percentile("value", 0.5, F.col("w")),
        "min": lambda: F.min("value"),
        "max": lambda: F.max("value"),
    }[method]()
    if floating:
        made = F.when(F.max(F.isnan("value")), F.lit(float("nan"))).otherwise(made)
    return rows.groupBy(*axes).agg(made.cast(kind).alias("value"))


def level_shapes(shape: Column, halved: Column, levels: int) -> Column:
    """Shapes of all levels: each halves, rounding up, the axes where ``halved`` is true."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(levels - 1)),
        lambda level: F.zip_with(shape, halved, lambda n, h: F.when(h, F.ceil(n / F.pow(F.lit(2), level))).otherwise(n).cast("long")),
    )


def level_scales(scale: Column, halved: Column, levels: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda level: F.zip_with(scale, halved, lambda s, h: F.when(h, s * F.pow(F.lit(2), level)).otherwise(s)))


def pyramid(cells: DataFrame, axes: list[str], sizes: Mapping[str, int], levels: int, method: str = "mean") -> DataFrame:
    """All levels as (level, axes, value); level k is pooled from level k - 1 with its type's rounding."""
    now, size = cells, dict(sizes)
    out = cells.select(F.lit(0).alias("level"), "*")
    for level in range(1, levels):
        now = pool(now, {a: 2 for a in axes}, size, method)
        size = {a: -(-n // 2) if a in axes else n for a, n in size.items()}
        out = out.unionByName(now.select(F.lit(level).alias("level"), "*"))
    return out


def drop_levels(levels: DataFrame) -> DataFrame:
    """Delete a pyramid: only the first level stays."""
    return levels.filter(F.col("level") == 0)


def regions(sizes: Mapping[str, int], step: Mapping[str, int], spark: SparkSession) -> DataFrame:
    """Work regions aligned to ``step``: start and stop on each axis, cut at the array's end."""
    out = grid(spark, {a: -(-n // step[a]) for a, n in sizes.items()})
    for a, n in sizes.items():
        start = F.col(a) * step[a]
        out = out.withColumn(f"{a}_start", start).withColumn(f"{a}_stop", F.least(start + step[a], F.lit(n))).drop(a)
    return out


def source_region(regions: DataFrame, factors: Mapping[str, int], sizes: Mapping[str, int]) -> DataFrame:
    """The region of the level below that a target region is pooled from."""
    out = regions
    for a, f in factors.items():
        out = out.withColumn(f"{a}_source_start", F.col(f"{a}_start") * f).withColumn(f"{a}_source_stop", F.least(F.col(f"{a}_stop") * f, F.lit(sizes[a])))
    return out
