"""Queries on arrays: selection, tiles, mutation, pooling, coordinates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxelframe.functions import names
from voxelframe.operators import cells as C
from voxelframe.operators import chunks, coords, images, pool, units, volumes
from voxelframe.plans.inputs import IMAGE_SQL, MOVIE_SQL, channels, image, image_sizes, movie, movie_sizes, table
from voxelframe.plans.registry import query
from voxelframe.sources import arrays
from voxelframe.sources.scratch import fresh_dir

# -- pooling --------------------------------------------------------------------------------

#: An independent statement of pooling: every axis is padded by repeating its edge, then grouped.
PADDED = """PAD AS (
  SELECT py // {fy} AS y, px // {fx} AS x, E.value
  FROM (SELECT unnest(range(CAST(ceil(ny / {fy}.0) AS BIGINT) * {fy})) AS py, ny, nx FROM S) a,
       LATERAL (SELECT unnest(range(CAST(ceil(a.nx / {fx}.0) AS BIGINT) * {fx})) AS px) b
  JOIN E ON E.y = least(py, ny - 1) AND E.x = least(px, nx - 1)
)"""
POOL_SQL = {
    "mean": "CAST(trunc(sum(value) / CAST(count(*) AS DOUBLE)) AS BIGINT)",
    "median": "CAST(trunc(quantile_cont(CAST(value AS DOUBLE), 0.5)) AS BIGINT)",
    "min": "min(value)",
    "max": "max(value)",
}


def _pooled(method: str, fy: int, fx: int):
    return lambda spark, d: pool.pool(image(spark, d), {"y": fy, "x": fx}, image_sizes(spark, d), method)


def _pooled_sql(method: str, fy: int, fx: int) -> str:
    with_ = f"WITH {IMAGE_SQL}, {PADDED.format(fy=fy, fx=fx)}"
    if method == "mode":
        return f"{with_} SELECT y, x, value FROM (SELECT y, x, value, row_number() OVER (PARTITION BY y, x ORDER BY count(*) DESC, value) AS n FROM PAD GROUP BY y, x, value) WHERE n = 1"
    return f"{with_} SELECT y, x, {POOL_SQL[method]} AS value FROM PAD GROUP BY y, x"


for _method in ("mean", "median", "min", "max", "mode"):
    query(f"pool_{_method}", _pooled_sql(_method, 2, 2))(_pooled(_method, 2, 2))
    query(f"pool_{_method}_ragged", _pooled_sql(_method, 7, 5))(_pooled(_method, 7, 5))
query("pool_stride", f"WITH {IMAGE_SQL} SELECT y // 3 AS y, x // 2 AS x, value FROM E WHERE y % 3 = 0 AND x % 2 = 0")(_pooled("stride", 3, 2))


def _cascade_sql(levels: int) -> str:
    parts, last = [f"WITH {IMAGE_SQL}, L0 AS (SELECT * FROM E)"], "SELECT 0 AS level, y, x, value FROM L0"
    for k in range(1, levels):
        parts.append(
            f""", Z{k} AS (SELECT max(y) AS my, max(x) AS mx FROM L{k - 1}), W{k} AS (
  SELECT y // 2 AS y, x // 2 AS x, value, (CASE WHEN y = my AND my % 2 = 0 THEN 2 ELSE 1 END) * (CASE WHEN x = mx AND mx % 2 = 0 THEN 2 ELSE 1 END) AS w FROM L{k - 1}, Z{k}
), L{k} AS (SELECT y, x, CAST(trunc(sum(value * w) / CAST(sum(w) AS DOUBLE)) AS BIGINT) AS value FROM W{k} GROUP BY y, x)"""
        )
        last += f" UNION ALL SELECT {k}, y, x, value FROM L{k}"
    return "".join(parts) + " " + last


@query("pyramid_cascade", _cascade_sql(4))
def pyramid_cascade(spark, d):
    return pool.pyramid(image(spark, d), ["y", "x"], image_sizes(spark, d), 4)


@query("delete_pyramid", _cascade_sql(1))
def delete_pyramid(spark, d):
    return pool.drop_levels(pool.pyramid(image(spark, d), ["y", "x"], image_sizes(spark, d), 3, "max"))


SHAPES_SQL = "G AS (SELECT label, CAST(count(*) AS BIGINT) AS n, CAST(max(len(embedding)) AS BIGINT) AS m FROM embeddings GROUP BY label)"


@query(
    "pyramid_shapes",
    f"WITH {SHAPES_SQL} SELECT label, CAST(k AS INTEGER) AS level, CAST(ceil(n / pow(2, k)) AS BIGINT) AS ny, CAST(ceil(m / pow(2, k)) AS BIGINT) AS nx, 0.5 * pow(2, k) AS scale FROM G, range(4) t(k)",
)
def pyramid_shapes(spark, d):
    groups = table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("embedding")).cast("long").alias("m"))
    halved = F.array(F.lit(False), F.lit(True), F.lit(True))
    shapes = pool.level_shapes(F.array(F.lit(1).cast("long"), "n", "m"), halved, 4)
    scales = pool.level_scales(F.array(F.lit(1.0), F.lit(0.5), F.lit(0.5)), halved, 4)
    rows = groups.select("label", F.posexplode(F.arrays_zip(shapes.alias("s"), scales.alias("k"))).alias("level", "v"))
    return rows.select("label", "level", F.col("v.s")[1].alias("ny"), F.col("v.s")[2].alias("nx"), F.col("v.k")[1].alias("scale"))


_REGION_SQL = f"""WITH {IMAGE_SQL} SELECT y * 48 AS y_start, least((y + 1) * 48, ny) AS y_stop, x * 10 AS x_start, least((x + 1) * 10, nx) AS x_stop%s
FROM S, range(0, CAST(ceil(ny / 48.0) AS BIGINT)) a(y), range(0, CAST(ceil(nx / 10.0) AS BIGINT)) b(x)"""


def _regions(spark, d):
    out = pool.regions(image_sizes(spark, d), {"y": 48, "x": 10}, spark)
    return out.select("y_start", F.col("y_stop").cast("long").alias("y_stop"), "x_start", F.col("x_stop").cast("long").alias("x_stop"))


query("region_grid", _REGION_SQL % "")(_regions)


@query("region_map", _REGION_SQL % ", y * 96 AS y_source_start, least(least((y + 1) * 48, ny) * 2, 2 * ny - 1) AS y_source_stop")
def region_map(spark, d):
    sizes = image_sizes(spark, d)
    return pool.source_region(_regions(spark, d), {"y": 2}, {"y": 2 * sizes["y"] - 1})


@query("max_projection", f"WITH {IMAGE_SQL} SELECT y, max(value) AS value FROM E GROUP BY y")
def max_projection(spark, d):
    return C.project(image(spark, d), "x")


@query("pyramid_chunks", f"WITH {IMAGE_SQL}, {PADDED.format(fy=2, fx=2)} SELECT y, x, {POOL_SQL['mean']} AS value FROM PAD GROUP BY y, x")
def pyramid_chunks(spark, d):
    """The first level pooled chunk by chunk: as pool_mean, without a row for each cell."""
    sizes, chunk = image_sizes(spark, d), {"y": 128, "x": 32}
    pooled = chunks.pool_chunks(arrays.to_chunks(image(spark, d), sizes, chunk), chunk, {"y": 2, "x": 2}, sizes)
    return C.fill_missing(arrays.to_cells(pooled, chunk), {a: -(-n // 2) for a, n in sizes.items()})


def _image_chunks(spark, d, chunk, shard=None):
    sizes = image_sizes(spark, d)
    cell = lambda v: (v.cast("double") * 1000).cast("long")
    return chunks.from_rows(table(spark, d, "embeddings"), "vec_id", "embedding", cell, chunk, sizes, shard=shard), sizes


@query("image_chunks", f"WITH {IMAGE_SQL} SELECT y, x, value FROM E")
def image_chunks(spark, d):
    """The image as chunk rows cut from its rows, and back."""
    chunk = {"y": 100, "x": 24}
    held, sizes = _image_chunks(spark, d, chunk)
    return C.fill_missing(arrays.to_cells(held, chunk), sizes)


@query("pyramid_chunk_levels", _cascade_sql(3))
def pyramid_chunk_levels(spark, d):
    """All levels from chunk rows: the same cells as the cascade on cells has."""
    chunk = {"y": 128, "x": 32}
    held, sizes = _image_chunks(spark, d, chunk)
    out = None
    for level, rows in enumerate(chunks.pyramid(held, chunk, ["y", "x"], sizes, 3)):
        own = C.fill_missing(arrays.to_cells(rows, chunk), {a: -(-n // 2**level) for a, n in sizes.items()})
        own = own.select(F.lit(level).alias("level"), "y", "x", "value")
        out = own if out is None else out.unionByName(own)
    return out


@query("map_chunks", f"WITH {IMAGE_SQL} SELECT y, x, value * 2 + 1 AS value FROM E WHERE x < 48 AND NOT (y < 100 AND x >= 24)")
def map_chunks(spark, d):
    """A user function on the first two columns of chunks, one of which was done before."""
    chunk = {"y": 100, "x": 24}
    held, sizes = _image_chunks(spark, d, chunk)
    done = spark.createDataFrame([(0, 1)], "y_chunk long, x_chunk long")
    return arrays.to_cells(chunks.map_chunks(held, lambda a: a * 2 + 1, {"x": [0, 1]}, done), chunk)


@query("rechunk", f"WITH {IMAGE_SQL} SELECT y, x, value FROM E")
def rechunk(spark, d):
    """The image in chunks that don't divide the old ones, by slices of chunks."""
    held, sizes = _image_chunks(spark, d, {"y": 100, "x": 24})
    to = {"y": 64, "x": 40}
    return C.fill_missing(arrays.to_cells(chunks.rechunk(held, {"y": 100, "x": 24}, to, sizes), to), sizes)


for _method in ("mean", "median", "min", "max", "mode"):

    def _shared(spark, d, method=_method):
        """Blocks of 7 by 5 from chunks of 30 by 12: nearly every chunk shares blocks with its neighbours."""
        chunk = {"y": 30, "x": 12}
        held, sizes = _image_chunks(spark, d, chunk)
        pooled = chunks.pool_chunks(held, chunk, {"y": 7, "x": 5}, sizes, method)
        return C.fill_missing(arrays.to_cells(pooled, chunk), {"y": -(-sizes["y"] // 7), "x": -(-sizes["x"] // 5)})

    query(f"pool_{_method}_chunk_borders", _pooled_sql(_method, 7, 5))(_shared)


@query(
    "chunk_selection",
    f"WITH {IMAGE_SQL} SELECT CAST(a.o AS BIGINT) AS y, (x - 10) // 3 AS x, value FROM E JOIN (VALUES (0, 150), (1, 7), (2, 33), (3, 7)) a(o, i) ON y = a.i WHERE x >= 10 AND (x - 10) % 3 = 0",
)
def chunk_selection(spark, d):
    """An orthogonal selection that reads chosen chunks alone, of a stored array."""
    chunk, store = {"y": 20, "x": 24}, fresh_dir(spark, "image.zarr")
    held, sizes = _image_chunks(spark, d, chunk, {"y": 2000, "x": 72})
    arrays.write(chunks.with_range(held), store)
    out, goal, size = chunks.select(spark.read.parquet(store), chunk, sizes, y=[150, 7, 33, 7], x=slice(10, None, 3))
    return C.fill_missing(arrays.to_cells(out, goal), size)


@query("skip_empty_chunks", f"WITH {IMAGE_SQL}, B AS (SELECT y // 20 AS cy, x // 4 AS cx, min(value) AS low, max(value) AS high FROM E GROUP BY 1, 2) SELECT cy, cx, low, high FROM B WHERE high > 370 OR low < -370")
def skip_empty_chunks(spark, d):
    """Chunks by the ranges stored with them: no cell is opened for those without a large value."""
    chunk, store = {"y": 20, "x": 4}, fresh_dir(spark, "image.zarr")
    held, _ = _image_chunks(spark, d, chunk, {"y": 2000, "x": 64})
    arrays.write(chunks.with_range(held), store)
    large = chunks.not_empty(spark.read.parquet(store)).filter("high > 370 or low < -370")
    return large.select(F.col("y_chunk").alias("cy"), F.col("x_chunk").alias("cx"), "low", "high")


# -- selection ------------------------------------------------------------------------------


@query("basic_slice", f"WITH {IMAGE_SQL} SELECT (y - 10) // 3 AS y, (x - 4) // 2 AS x, value FROM E, S WHERE y >= 10 AND y < ny - 5 AND (y - 10) % 3 = 0 AND x >= 4 AND x < 60 AND (x - 4) % 2 = 0")
def basic_slice(spark, d):
    return C.select(image(spark, d), image_sizes(spark, d), y=slice(10, -5, 3), x=slice(4, 60, 2))


@query("basic_index", f"WITH {IMAGE_SQL} SELECT y, value FROM E WHERE x = (SELECT nx - 1 FROM S)")
def basic_index(spark, d):
    return C.select(image(spark, d), image_sizes(spark, d), x=-1)


@query(
    "orthogonal_index",
    f"WITH {IMAGE_SQL} SELECT CAST(a.o AS BIGINT) AS y, CAST(b.o AS BIGINT) AS x, value FROM E JOIN (VALUES (0, 400), (1, 7), (2, 33), (3, 7)) a(o, i) ON y = a.i JOIN (VALUES (0, 63), (1, 0), (2, 10)) b(o, i) ON x = b.i",
)
def orthogonal_index(spark, d):
    return C.select(image(spark, d), image_sizes(spark, d), y=[400, 7, 33, 7], x=[63, 0, 10])


@query("cc_index", f"WITH {MOVIE_SQL} SELECT CAST(a.o AS BIGINT) AS t, c - 1 AS c, value FROM V JOIN (VALUES (0, 20), (1, 3), (2, 11)) a(o, i) ON t = a.i WHERE c >= 1")
def cc_index(spark, d):
    return C.select(movie(spark, d), movie_sizes(spark, d), t=[20, 3, 11], c=slice(1, None))


@query("tile_grid", f"WITH {IMAGE_SQL} SELECT CAST(ny // 48 AS BIGINT) AS n_rows, CAST(nx // 10 AS BIGINT) AS n_columns FROM S")
def tile_grid(spark, d):
    sizes = image_sizes(spark, d)
    n = C.tile_grid(sizes, {"y": 48, "x": 10})
    return spark.createDataFrame([(n["y"], n["x"])], "n_rows long, n_columns long")


@query("tile_read", f"WITH {IMAGE_SQL} SELECT y - 96 AS y, x - 30 AS x, value FROM E WHERE y // 48 = 2 AND x // 10 = 3")
def tile_read(spark, d):
    return C.read_tile(image(spark, d), 2, 3, (48, 10), image_sizes(spark, d))


@query("tile_write", f"WITH {IMAGE_SQL} SELECT y, x, CASE WHEN y // 48 = 1 AND x // 10 = 2 THEN y - 48 + x - 20 ELSE value END AS value FROM E")
def tile_write(spark, d):
    tile = C.grid(spark, {"y": 48, "x": 10}).withColumn("value", F.col("y") + F.col("x"))
    return C.write_tile(image(spark, d), tile, 1, 2, (48, 10), image_sizes(spark, d))


_STACK = "T AS (SELECT y // 100 AS t, y % 100 AS y, x, value FROM E)"


def _stack(spark, d):
    """The image's rows as times of a hundred rows each."""
    sizes = image_sizes(spark, d)
    cells = image(spark, d).select(F.floor(F.col("y") / 100).cast("long").alias("t"), (F.col("y") % 100).alias("y"), "x", "value")
    return cells, {"t": -(-sizes["y"] // 100), "y": 100, "x": sizes["x"]}


@query("tile_read_time", f"WITH {IMAGE_SQL}, {_STACK} SELECT y - 48 AS y, x - 20 AS x, value FROM T WHERE t = 1 AND y // 48 = 1 AND x // 10 = 2")
def tile_read_time(spark, d):
    cells, sizes = _stack(spark, d)
    return C.read_tile(cells, 1, 2, (48, 10), sizes, t=1)


@query("tile_write_time", f"WITH {IMAGE_SQL}, {_STACK} SELECT t, y, x, CASE WHEN t = 1 AND y // 48 = 1 AND x // 10 = 2 THEN y - 48 + x - 20 ELSE value END AS value FROM T")
def tile_write_time(spark, d):
    cells, sizes = _stack(spark, d)
    tile = C.grid(spark, {"y": 48, "x": 10}).withColumn("value", F.col("y") + F.col("x"))
    return C.write_tile(cells, tile, 1, 2, (48, 10), sizes, t=1)


@query("tiled_image", f"WITH {IMAGE_SQL} SELECT y, x, value FROM E, S WHERE y < ny // 48 * 48 AND x < nx // 10 * 10")
def tiled_image(spark, d):
    """The image of all whole tiles, put together from them."""
    sizes = image_sizes(spark, d)
    grid = C.tile_grid(sizes, {"y": 48, "x": 10})
    tiles = C.make_tiles(image(spark, d), (48, 10)).filter((F.col("tile_row") < grid["y"]) & (F.col("tile_column") < grid["x"]))
    return C.join_tiles(tiles, (grid["y"], grid["x"]), (48, 10))[0]


@query("make_tiles", f"WITH {IMAGE_SQL} SELECT y // 48 AS tile_row, x // 10 AS tile_column, y % 48 AS y, x % 10 AS x, value FROM E")
def make_tiles(spark, d):
    return C.make_tiles(image(spark, d), (48, 10))


@query("sel_label", f"WITH {MOVIE_SQL} SELECT t, 5.0 + t * 0.5 AS t_coord, value FROM V JOIN N USING (c) WHERE event_type = (SELECT max(event_type) FROM N) AND 5.0 + t * 0.5 >= 6.5")
def sel_label(spark, d):
    one = C.select(movie(spark, d), movie_sizes(spark, d), c=len(channels(spark, d)) - 1)
    return coords.with_coordinates(one, {"t": (0.5, 5.0)}).filter("t_coord >= 6.5").select("t", "t_coord", "value")


@query(
    "channel_index",
    "WITH CH AS (SELECT image, name, row_number() OVER (PARTITION BY image ORDER BY name) - 1 AS i FROM (SELECT DISTINCT c_nationkey AS image, c_mktsegment AS name FROM customer))"
    " SELECT c_custkey, CAST(i AS BIGINT) AS index FROM customer JOIN CH ON image = c_nationkey AND name = c_mktsegment",
)
def channel_index(spark, d):
    wanted = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("image"), F.col("c_mktsegment").alias("name"))
    return images.channel_index(_channels(spark, d), wanted).select("c_custkey", "index")


@query(
    "skip_empty",
    f"WITH {MOVIE_SQL}, B AS (SELECT t // 6 AS b, t, c, CASE WHEN value % 3 = 0 THEN 0 ELSE value END AS value FROM V), "
    "X AS (SELECT b FROM (SELECT b, c, bool_and(value = 0) AS z FROM B GROUP BY b, c) WHERE z) SELECT b, t, c, value FROM B WHERE b NOT IN (SELECT b FROM X)",
)
def skip_empty(spark, d):
    v = movie(spark, d)
    blocks = v.select(F.floor(F.col("t") / 6).cast("long").alias("b"), "t", "c", F.when(F.col("value") % 3 == 0, 0).otherwise(F.col("value")).cast("long").alias("value"))
    return C.drop_empty(blocks, ["b"], "c")


# -- mutation -------------------------------------------------------------------------------

_FULL = "FROM Z, range(0, nt{dt}) a(t), range(0, nc{dc}) b(c) LEFT JOIN V ON V.t = a.t AND V.c = b.c"


@query("fill_missing", f"WITH {MOVIE_SQL} SELECT a.t AS t, b.c AS c, coalesce(value, 0) AS value {_FULL.format(dt='', dc='')}")
def fill_missing(spark, d):
    return C.fill_missing(movie(spark, d), movie_sizes(spark, d))


@query("resize", f"WITH {MOVIE_SQL} SELECT t, c, value FROM V WHERE c < 2 UNION ALL SELECT t, c, CAST(0 AS BIGINT) FROM Z, range(0, nt + 3) a(t), range(0, 2) b(c) WHERE t >= nt")
def resize(spark, d):
    old = movie_sizes(spark, d)
    return C.resize(movie(spark, d), old, {"t": old["t"] + 3, "c": 2})


@query("append_axis", f"WITH {MOVIE_SQL} SELECT t, c, value FROM V UNION ALL SELECT t + nt, c, -value FROM V, Z")
def append_axis(spark, d):
    v = movie(spark, d)
    return C.append(v, v.withColumn("value", -F.col("value")), "t", movie_sizes(spark, d)["t"])


@query("append_channel", f"WITH {MOVIE_SQL} SELECT t, c, value FROM V UNION ALL SELECT t, nc, CAST(0 AS BIGINT) FROM Z, range(0, nt) a(t)")
def append_channel(spark, d):
    old = movie_sizes(spark, d)
    return C.resize(movie(spark, d), old, old | {"c": old["c"] + 1})


@query("update_channel", f"WITH {MOVIE_SQL} SELECT t, c, value FROM V WHERE c <> 1 UNION ALL SELECT t, 1, t * 10 FROM Z, range(0, nt) a(t)")
def update_channel(spark, d):
    slab = spark.range(movie_sizes(spark, d)["t"]).select(F.col("id").alias("t"), F.lit(1).cast("long").alias("c"), (F.col("id") * 10).alias("value"))
    return C.overwrite(movie(spark, d), slab, ["t", "c"], F.col("c") == 1)


@query("rename_channel", "SELECT DISTINCT c_nationkey AS image, CASE WHEN c_mktsegment = 'BUILDING' THEN 'HOUSES' ELSE c_mktsegment END AS name FROM customer")
def rename_channel(spark, d):
    return images.rename_channel(_channels(spark, d), "BUILDING", "HOUSES").select("image", "name")


@query("user_map", f"WITH {IMAGE_SQL} SELECT y // 50 AS block, y % 50 AS y, x, value * 3 + (y // 50) AS value FROM E")
def user_map(spark, d):
    """A user function over blocks of rows; the block's number plays the part of its time index."""
    e = image(spark, d)
    blocks = e.select(F.floor(F.col("y") / 50).cast("long").alias("t"), (F.col("y") % 50).alias("y"), "x", "value")

    def scaled(volume, input_time_index):
        return volume * 3 + input_time_index

    return volumes.apply_to_volumes(blocks, scaled, ["t"], {"y": 50, "x": image_sizes(spark, d)["x"]}, sparse=True).withColumnRenamed("t", "block")


@query("user_map_rows", "SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 2 AS first, CAST(embedding[len(embedding)] AS DOUBLE) * 2 AS last FROM embeddings")
def user_map_rows(spark, d):
    out = volumes.map_rows(table(spark, d, "embeddings"), "embedding", lambda m: m * 2, ["vec_id"])
    return out.select("vec_id", F.col("embedding")[0].cast("double").alias("first"), F.element_at("embedding", -1).cast("double").alias("last"))


# -- coordinates ----------------------------------------------------------------------------


@query("coords", f"WITH {SHAPES_SQL} SELECT label, CAST(i AS BIGINT) AS i, i * 0.25 + CAST(coalesce(label, 0) AS DOUBLE) AS coord FROM G, LATERAL (SELECT unnest(range(n)) AS i)")
def coordinates(spark, d):
    groups = table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    return coords.exploded(groups, "n", F.lit(0.25), F.coalesce("label", F.lit(0)).cast("double"))


@query("coords_join", f"WITH {IMAGE_SQL} SELECT y, x, value, y * 0.5 - 3.0 AS y_coord, x * 2.0 AS x_coord FROM E")
def coords_join(spark, d):
    return coords.with_coordinates(image(spark, d), {"y": (0.5, -3.0), "x": (2.0, 0.0)})


@query("coord_to_index", "SELECT c_custkey, CAST(round_even((c_acctbal - 10.0) / 0.5, 0) AS BIGINT) AS i FROM customer")
def coord_to_index(spark, d):
    return table(spark, d, "customer").select("c_custkey", coords.index_of(F.col("c_acctbal"), F.lit(0.5), F.lit(10.0)).alias("i"))


@query("infer_scale", "SELECT vec_id, CASE WHEN len(embedding) >= 2 THEN CAST(embedding[2] AS DOUBLE) - CAST(embedding[1] AS DOUBLE) ELSE 1.0 END AS scale FROM embeddings")
def infer_scale(spark, d):
    return table(spark, d, "embeddings").select("vec_id", coords.infer_scale(F.col("embedding").cast("array<double>")).alias("scale"))


@query("write_labelled", f"WITH {IMAGE_SQL} SELECT y, x, CASE WHEN x = 5 THEN y * 7 ELSE value END AS value FROM E")
def write_labelled(spark, d):
    e = image(spark, d)
    new = e.filter("x = 5").select("y", (F.col("x") * 2.0 + 1.2).alias("x_coord"), (F.col("y") * 7).alias("value"))
    return coords.write_labelled(e, new, ["y", "x"], {"x": (2.0, 1.0)})


@query(
    "write_by_name",
    f"WITH {MOVIE_SQL}, D AS (SELECT t, c, -t * 3 AS value FROM V JOIN N USING (c) WHERE event_type = (SELECT max(event_type) FROM N) AND t % 2 = 0)"
    " SELECT t, c, value FROM V WHERE (t, c) NOT IN (SELECT t, c FROM D) UNION ALL SELECT t, c, value FROM D",
)
def write_by_name(spark, d):
    """New values for every other hour of one channel, given by the channel's name and the time in seconds."""
    listed = channels(spark, d)
    known = spark.createDataFrame([(n, k) for k, n in enumerate(listed)], "name string, index long")
    v = movie(spark, d)
    new = v.filter((F.col("c") == len(listed) - 1) & (F.col("t") % 2 == 0))
    new = new.select((F.col("t") * 3600.0 + 1000.0).alias("t_coord"), F.lit(listed[-1]).alias("c_name"), (F.col("t") * -3).alias("value"))
    return coords.write_labelled(v, new, ["t", "c"], {"t": (3600.0, 0.0)}, {"c": known})


_TRANSFORMS = """T AS (
  SELECT s_nationkey AS k, 'scale' AS type, [1.0, 1.0 + (s_suppkey % 2), 0.5 + (s_suppkey % 2) * 1.5] AS v FROM supplier
  UNION ALL SELECT s_nationkey, 'translation', [CAST(s_suppkey AS DOUBLE), 0.0, s_suppkey * 0.25] FROM supplier
)"""


def _transforms(spark, d):
    s = table(spark, d, "supplier")
    odd = F.col("s_suppkey") % 2
    scale = s.select(F.col("s_nationkey").alias("k"), F.lit("scale").alias("type"), F.array(F.lit(1.0), 1.0 + odd, 0.5 + odd * 1.5).alias("values"))
    moved = s.select(F.col("s_nationkey").alias("k"), F.lit("translation").alias("type"), F.array(F.col("s_suppkey").cast("double"), F.lit(0.0), F.col("s_suppkey") * 0.25).alias("values"))
    return coords.effective(scale.unionByName(moved), ["k"])


@query("effective_scale", f"WITH {_TRANSFORMS} SELECT k, CAST(i - 1 AS INTEGER) AS axis, product(v[i]) AS scale FROM T, range(1, 4) r(i) WHERE type = 'scale' GROUP BY k, i")
def effective_scale(spark, d):
    return _transforms(spark, d).select("k", "axis", "scale")


@query("effective_translation", f"WITH {_TRANSFORMS} SELECT k, CAST(i - 1 AS INTEGER) AS axis, sum(v[i]) AS translation FROM T, range(1, 4) r(i) WHERE type = 'translation' GROUP BY k, i")
def effective_translation(spark, d):
    return _transforms(spark, d).select("k", "axis", "translation")


@query(
    "set_scale",
    "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 10.0::DOUBLE ELSE 1.0::DOUBLE + n_nationkey END AS scale_z, CASE WHEN n_regionkey = 1 THEN 1 ELSE 0 END AS n_history FROM nation",
)
def set_scale(spark, d):
    images = table(spark, d, "nation").select("n_nationkey", "n_regionkey", F.array(1.0 + F.col("n_nationkey"), F.lit(0.5)).alias("scale"), F.array().cast("array<array<double>>").alias("history"))
    out = coords.set_scale(images, 0, 10.0, F.col("n_regionkey") == 1)
    return out.select("n_nationkey", F.col("scale")[0].alias("scale_z"), F.size("history").alias("n_history"))


@query(
    "set_transform",
    "SELECT CAST(n_nationkey AS VARCHAR) AS image, CAST(0 AS BIGINT) AS ordinal, 'scale' AS type, n_regionkey + 1.0::DOUBLE AS first FROM nation WHERE n_nationkey <> 3"
    " UNION ALL SELECT '3', CAST(0 AS BIGINT), 'scale', 2.5::DOUBLE UNION ALL SELECT '3', CAST(1 AS BIGINT), 'translation', 4.0::DOUBLE",
)
def set_transform(spark, d):
    old = table(spark, d, "nation").select(
        F.col("n_nationkey").cast("string").alias("image"), F.lit(0).cast("long").alias("ordinal"), F.lit("scale").alias("type"), F.array(F.col("n_regionkey") + 1.0, F.lit(0.5)).alias("values")
    )
    out = coords.replace_transforms(old, "3", [("scale", [2.5, 1.0]), ("translation", [4.0, 0.0])])
    return out.select("image", "ordinal", "type", F.col("values")[0].alias("first"))


def _channels(spark, d):
    """Segments of customers as the channels of nations, in the order of their names."""
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("image"), F.col("c_mktsegment").alias("name")).distinct()
    return rows.withColumn("index", (F.row_number().over(Window.partitionBy("image").orderBy("name")) - 1).cast("long"))


_CHANNELS = "CH AS (SELECT image, name, CAST(row_number() OVER (PARTITION BY image ORDER BY name) - 1 AS BIGINT) AS index FROM (SELECT DISTINCT c_nationkey AS image, c_mktsegment AS name FROM customer))"


@query(
    "set_contrast_limits",
    f"WITH {_CHANNELS} SELECT image, name, CASE WHEN image = 5 AND name = 'BUILDING' THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END AS \"start\","
    " CASE WHEN image = 5 AND name = 'BUILDING' THEN 200.5::DOUBLE ELSE 65535.0::DOUBLE END AS \"end\", 0.0::DOUBLE AS least, 65535.0::DOUBLE AS most FROM CH",
)
def set_contrast_limits(spark, d):
    rows = _channels(spark, d).withColumn("window", names.display_window(F.col("name")))
    out = images.set_window(rows, 5, "BUILDING", 10.0, 200.5)
    return out.select("image", "name", "window.start", "window.end", F.col("window.min").alias("least"), F.col("window.max").alias("most"))


@query("channel_limits", f"WITH {MOVIE_SQL} SELECT c, min(value) AS \"start\", max(value) AS \"end\" FROM V GROUP BY c")
def channel_limits(spark, d):
    """The least and largest value of each channel, as limits to set."""
    return movie(spark, d).groupBy("c").agg(F.min("value").alias("start"), F.max("value").alias("end"))


@query("process_positions", f"WITH {IMAGE_SQL} SELECT o AS t, y % 50 AS y, x, value * 3 + i AS value FROM E JOIN (VALUES (0, 1), (2, 0)) P(i, o) ON y // 50 = i WHERE o <> 5")
def process_positions(spark, d):
    """Two blocks of rows, written to places of their own; the third was done before."""
    blocks = image(spark, d).select(F.floor(F.col("y") / 50).cast("long").alias("t"), (F.col("y") % 50).alias("y"), "x", "value")
    done = spark.createDataFrame([(5,)], "t_out long")
    scaled = lambda volume, input_time_index: volume * 3 + input_time_index
    return volumes.process_positions(blocks, scaled, ["t"], {"y": 50, "x": image_sizes(spark, d)["x"]}, {"t": [(0, 1), (2, 0), (1, 5)]}, done, sparse=True)


@query("process_units", f"WITH {IMAGE_SQL} SELECT r AS run, o AS t, y % 50 AS y, x, value * 3 + i AS value FROM E JOIN (VALUES (0, 1, 1), (2, 0, 1), (1, 5, 2)) P(i, o, r) ON y // 50 = i")
def process_units(spark, d):
    """Blocks of rows as times of a position: two are written by a first run, and a second that is to write three makes the third."""
    sizes, chunk = image_sizes(spark, d), {"t": 1, "c": 1, "z": 1, "y": 50, "x": 24}
    whole = {"y": -(-sizes["y"] // 50) * 50, "x": sizes["x"]}
    cell = lambda v: (v.cast("double") * 1000).cast("long")
    held = chunks.from_rows(table(spark, d, "embeddings"), "vec_id", "embedding", cell, {"y": 50, "x": 24}, whole)
    one = F.lit(0).cast("long")
    source = held.select(F.lit("A/1/0").alias("position"), F.col("y_chunk").alias("t_chunk"), one.alias("c_chunk"), one.alias("z_chunk"), one.alias("y_chunk"), "x_chunk", F.concat(F.array_repeat(F.lit(1), 3), "shape").alias("shape"), "values")
    size = {"t": whole["y"] // 50, "c": 1, "z": 1, "y": 50, "x": sizes["x"]}
    store, pairs = fresh_dir(spark, "mapped"), [(0, 1), (2, 0), (1, 5)]
    scaled = lambda volume, input_time_index: volume * 3 + input_time_index
    for some in (pairs[:2], pairs):
        units.process(source, store, scaled, chunk, size, times=some, out_sizes=size | {"t": max(6, size["t"])}, resume=True)
    made = units.read(spark, store)
    cells = arrays.to_cells(made, chunk).join(made.select(F.col("t_chunk").alias("t"), "run").distinct(), "t")
    # Rows beyond the image's last were padded to whole blocks.
    inside = F.when(F.col("t") == 1, 0).when(F.col("t") == 0, 100).otherwise(50) + F.col("y") < sizes["y"]
    return cells.filter(inside).select("run", "t", "y", "x", "value")


@query(
    "create_zeros",
    "WITH G AS (SELECT label AS image, count(*) AS n FROM embeddings GROUP BY 1) SELECT image, CAST(0 AS BIGINT) AS level, n AS height, CAST(64 AS BIGINT) AS width, 1.0::DOUBLE AS scale FROM G"
    " UNION ALL SELECT image, CAST(1 AS BIGINT), (n + 1) // 2, CAST(32 AS BIGINT), 2.0::DOUBLE FROM G WHERE image < 5",
)
def create_zeros(spark, d):
    """A second level for some images, as records alone."""
    n = table(spark, d, "embeddings").groupBy(F.col("label").alias("image")).agg(F.count("*").alias("n"))
    levels = n.select("image", F.lit(0).cast("long").alias("level"), F.array("n", F.lit(64).cast("long")).alias("shape"), F.lit("float32").alias("dtype"), F.lit([1.0, 1.0]).alias("scale"))
    new = n.filter("image < 5").select("image", F.array(F.floor((F.col("n") + 1) / 2), F.lit(32).cast("long")).alias("shape"), F.lit("float32").alias("dtype"))
    out = arrays.create_zeros(levels, new, [2.0, 2.0])
    return out.select("image", "level", F.col("shape")[0].alias("height"), F.col("shape")[1].alias("width"), F.col("scale")[0].alias("scale"))
