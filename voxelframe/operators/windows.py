"""Order-dependent operators: runs, differences, grids, last entries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.sources.scratch import fresh_dir


def differences(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Each row's value less that of the row before it in its group; null for the first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("delta", F.col(value) - F.lag(value).over(w))


def step(df: DataFrame, keys: list[str], order: str, value: str, digits: int = 3) -> DataFrame:
    """Distance of the first two values of each group, rounded half to even."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.select(*keys, F.row_number().over(w).alias("n"), F.bround(F.abs(F.lead(value).over(w) - F.col(value)), digits).alias("step"))
    return rows.filter("n = 1").select(*keys, "step")


def contiguous_runs(df: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Maximal runs of consecutive indices: keys, start, stop (the last index plus one), n."""
    w = Window.partitionBy(*keys).orderBy("i")
    marked = df.select(*keys, F.col(index).alias("i")).distinct().withColumn("island", F.col("i") - F.row_number().over(w))
    return marked.groupBy(*keys, "island").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("stop"), F.count("*").alias("n")).drop("island")


def stage_grid(df: DataFrame, keys: list[str], columns: Column, y: str, x: str) -> DataFrame:
    """Row and column of positions laid out on a grid: by y, then x, filled row by row."""
    w = Window.partitionBy(*keys).orderBy(y, x)
    n = F.row_number().over(w) - 1
    return df.withColumn("grid_row", F.floor(n / columns).cast("long")).withColumn("grid_column", (n % columns).cast("long"))


def last_entries(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; rows combine before the shuffle."""
    return _one(df, keys, F.max_by, order)


def first_source(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key from the source that comes first."""
    return _one(df, keys, F.min_by, [order])


def _one(df: DataFrame, keys: list[str], pick: Callable, order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("__row"))
    return one.select(*keys, "__row.*").select(*df.columns)


def numbered(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "n") -> DataFrame:
    """Number the rows of each group from 1 in an order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def distinct_indices(df: DataFrame, index: str) -> DataFrame:
    """Each index once, in order."""
    return df.select(index).distinct().orderBy(index)


def ordinals(df: DataFrame, order: list[str], name: str = "ordinal") -> DataFrame:
    """Number all rows from 0 in an order, without bringing them to one task.

    Rows are dealt to ranges, sorted within them and written once, so that the ranges' sizes and
    the places in them are of one dealing; then each range begins where those before it end.
    """
    spark = df.sparkSession
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    path = fresh_dir(spark, "ordinals")
    parts.write.parquet(path)
    parts = spark.read.schema(parts.schema).parquet(path)
    parts = parts.withColumn("__part", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND((1 << 33) - 1))
    sizes = parts.groupBy("__part").agg(F.count("*").alias("n"))
    # One row for each partition.
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.join(sizes.select("__part", before.alias("__before")), "__part").withColumn(name, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")
