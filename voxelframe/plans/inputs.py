"""The tables that queries run on, as arrays and hierarchies, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.operators import cells as C
from voxelframe.operators import hierarchy as H


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quantised(column: Column, by: int = 1000) -> Column:
    """Whole numbers, cut towards zero, so that sums don't depend on their order."""
    return (column.cast("double") * by).cast("long")


def image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as a 2-D array (y, x, value)."""
    return C.from_rows(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", quantised(F.col("value")))


def image_sizes(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    top = table(spark, sf_dir, "embeddings").agg(F.coalesce(F.max("vec_id") + 1, F.lit(0)), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    return {"y": int(top[0]), "x": int(top[1])}


IMAGE_SQL = """E AS (
  SELECT CAST(vec_id AS BIGINT) AS y, CAST(i - 1 AS BIGINT) AS x, CAST(trunc(CAST(embedding[i] AS DOUBLE) * 1000) AS BIGINT) AS value
  FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)
), S AS (SELECT (SELECT max(vec_id) + 1 FROM embeddings) AS ny, (SELECT max(len(embedding)) FROM embeddings) AS nx)"""


def hour(column: str = "ts") -> Column:
    return F.expr(f"timestampdiff(HOUR, timestamp_ntz'1970-01-01 00:00:00', {column})")


def channels(spark: SparkSession, sf_dir: str) -> list[str]:
    """Channel names: the event types, a handful, in order."""
    return [r[0] for r in table(spark, sf_dir, "events").select("event_type").distinct().orderBy("event_type").collect()]


def movie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a sparse array: t hours since the first, c the event type, value a sum of hundredths."""
    events = table(spark, sf_dir, "events")
    first = events.agg(F.min(hour())).first()[0] or 0
    names = F.array(*[F.lit(n) for n in channels(spark, sf_dir)])
    rows = events.select((hour() - first).alias("t"), (F.array_position(names, F.col("event_type")) - 1).alias("c"), F.floor(F.col("value") * 100).cast("long").alias("v"))
    return rows.groupBy("t", "c").agg(F.sum("v").alias("value"))


def movie_sizes(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    top = table(spark, sf_dir, "events").agg(F.max(hour()) - F.min(hour()) + 1, F.count_distinct("event_type")).first()
    return {"t": int(top[0] or 0), "c": int(top[1])}


MOVIE_SQL = """N AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS c FROM (SELECT DISTINCT event_type FROM events)
), H AS (SELECT date_diff('hour', TIMESTAMP '1970-01-01', ts) AS h, event_type, CAST(floor(value * 100) AS BIGINT) AS v FROM events
), V AS (SELECT CAST(h - (SELECT min(h) FROM H) AS BIGINT) AS t, CAST(c AS BIGINT) AS c, CAST(sum(v) AS BIGINT) AS value FROM H JOIN N USING (event_type) GROUP BY 1, 2
), Z AS (SELECT (SELECT max(h) - min(h) + 1 FROM H) AS nt, (SELECT count(*) FROM N) AS nc)"""


def plate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and suppliers as rows, wells and positions."""
    rows = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("row_id"), F.col("r_name").alias("row"))
    wells = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("well_id"), F.col("n_regionkey").alias("row_id"), F.col("n_name").alias("column"))
    fields = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("well_id"), F.col("s_suppkey").cast("string").alias("field"))
    return H.positions(rows, wells, fields)


PLATE_SQL = """P AS (
  SELECT r_name AS "row", n_name AS "column", CAST(s_suppkey AS VARCHAR) AS field, r_name || '/' || n_name || '/' || CAST(s_suppkey AS VARCHAR) AS path
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""
