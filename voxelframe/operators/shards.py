"""Planning of shard-aligned work: batches, coverage, units and their completion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shard_batches(df: DataFrame, keys: list[str], index: str, size: int) -> DataFrame:
    """Indices grouped by the shard they fall in: keys, shard, sorted indices."""
    shard = F.floor(F.col(index) / size).cast("long").alias("shard")
    return df.groupBy(*keys, shard).agg(F.array_sort(F.collect_set(F.col(index))).alias("indices"))


def covered_cells(df: DataFrame, keys: list[str], index: str, size: int, extent: Column) -> DataFrame:
    """Shards that a selection touches, and whether it holds all their indices that exist."""
    shard = F.floor(F.col(index) / size).cast("long")
    touched = df.select(*keys, F.col(index).alias("__i"), shard.alias("shard"), extent.alias("__n")).distinct()
    in_bounds = F.least((F.col("shard") + 1) * size, F.max("__n")) - F.col("shard") * size
    return touched.groupBy(*keys, "shard").agg((F.count("__i") == in_bounds).alias("owned"))


def unit_product(df: DataFrame, keys: list[str], channels_in: Column, channels_out: Column, times_in: Column, times_out: Column) -> DataFrame:
    """Every pairing of a channel pair with a time pair, from one row of lists: two explodes, no join."""
    one = df.select(*keys, F.explode(F.arrays_zip(channels_in.alias("c_in"), channels_out.alias("c_out"))).alias("c"), times_in.alias("ti"), times_out.alias("to"))
    two = one.select(*keys, "c", F.explode(F.arrays_zip("ti", "to")).alias("t"))
    return two.select(*keys, F.col("c.c_in").alias("c_in"), F.col("c.c_out").alias("c_out"), F.col("t.ti").alias("t_in"), F.col("t.to").alias("t_out"))


def match_batches(reference: DataFrame, batches: DataFrame, keys: list[str]) -> DataFrame:
    """Give each batch member the partner at its first place in the reference.

    reference (keys, index, partner, place), batches (keys, batch, index).
    """
    first = reference.groupBy(*keys, "index").agg(F.min_by("partner", "place").alias("partner"))
    return batches.join(first, [*keys, "index"])


def unit_name(t: Column, c: Column, token: Column) -> Column:
    """A short stable name of a unit of work."""
    return F.substr(F.sha2(F.concat_ws("|", t.cast("string"), c.cast("string"), token), 256), F.lit(1), F.lit(12))


def complete_units(recorded: DataFrame, stored: DataFrame, units: DataFrame) -> DataFrame:
    """Units whose recorded shards are exactly the stored ones. All have (unit, shard); a unit without a record isn't complete."""
    both = recorded.withColumn("r", F.lit(True)).join(stored.withColumn("s", F.lit(True)), ["unit", "shard"], "full_outer")
    same = both.groupBy("unit").agg(F.bool_and(F.coalesce("r", F.lit(False)) & F.coalesce("s", F.lit(False))).alias("same"))
    return units.select("unit").distinct().join(same, "unit", "left").select("unit", F.coalesce("same", F.lit(False)).alias("complete"))
