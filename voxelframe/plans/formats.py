"""Queries on formats, series and what acquisitions leave out."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelframe.operators import cells as C
from voxelframe.operators import hierarchy as H
from voxelframe.plans.inputs import MOVIE_SQL, PLATE_SQL, movie, movie_sizes, plate, table
from voxelframe.plans.registry import query
from voxelframe.sources import formats

_SUFFIXES = (".nd2", ".ozx", ".ZARR/0", "", ".ome.tif", ".tiff", ".txt")


@query(
    "infer_format",
    "SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'nd2' WHEN 1 THEN 'archive' WHEN 2 THEN 'zarr' WHEN 3 THEN 'ndtiff' WHEN 4 THEN 'ome-tiff' WHEN 5 THEN 'single-page-tiff' END AS format, p_partkey % 7 = 1 AS replaceable FROM part",
)
def infer_format(spark, d):
    suffix = F.element_at(F.array(*[F.lit(s) for s in _SUFFIXES]), (F.col("p_partkey") % 7 + 1).cast("int"))
    path = F.concat(F.lit("data/a"), F.col("p_partkey").cast("string"), suffix)
    return table(spark, d, "part").select("p_partkey", formats.infer_format(path, F.col("p_partkey") % 7 == 3).alias("format"), formats.may_overwrite(path).alias("replaceable"))


_FILES = "(SELECT p_partkey // 10 AS k, p_partkey % 10 AS j FROM part)"


@query(
    "infer_from_files",
    "SELECT 'data/a' || k AS root, CASE k % 6 WHEN 0 THEN CASE WHEN bool_or(j = 3) THEN 'zarr' END WHEN 1 THEN CASE WHEN bool_or(j = 4) THEN 'ndtiff' ELSE 'single-page-tiff' END WHEN 2 THEN CASE WHEN bool_or(j % 2 = 1) THEN 'clearcontrol' END"
    f" WHEN 3 THEN CASE WHEN bool_or(j = 7) THEN 'ome-tiff' ELSE 'single-page-tiff' END WHEN 4 THEN 'single-page-tiff' END AS format FROM {_FILES} GROUP BY k",
)
def infer_from_files(spark, d):
    """Formats of folders by the files that lie in them."""
    k, j = F.floor(F.col("p_partkey") / 10), F.col("p_partkey") % 10
    other = lambda before, after: F.concat(F.lit(before), j.cast("string"), F.lit(after))
    name = (
        F.when(k % 6 == 0, F.when(j == 3, "zarr.json").otherwise(other("c/0/", "")))
        .when(k % 6 == 1, F.when(j == 4, "NDTiff.index").otherwise(other("x_", ".TIF")))
        .when(k % 6 == 2, F.when(j % 2 == 1, other("C", ".index.txt")).otherwise(other("C", ".metadata.txt")))
        .when(k % 6 == 3, F.when(j == 7, "a.ome.tif").otherwise(other("b", ".tif")))
        .when(k % 6 == 4, other("sub/b", ".tiff"))
        .otherwise(other("notes", ".txt"))
    )
    root = F.concat(F.lit("data/a"), k.cast("string"))
    return formats.infer_from_files(table(spark, d, "part").select(root.alias("root"), F.concat(root, F.lit("/"), name).alias("path")))


@query("reader", "SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'nd2' WHEN 1 THEN 'archive' WHEN 2 THEN 'zarr' WHEN 3 THEN 'ndtiff' WHEN 4 THEN 'ome-tiff' WHEN 5 THEN 'single-page-tiff' ELSE 'zarr' END AS reader FROM part")
def reader(spark, d):
    """The reader of every path; where the name tells nothing the kind is asked for."""
    suffix = F.element_at(F.array(*[F.lit(s) for s in _SUFFIXES]), (F.col("p_partkey") % 7 + 1).cast("int"))
    path = F.concat(F.lit("data/a"), F.col("p_partkey").cast("string"), suffix)
    kind = F.when(F.col("p_partkey") % 7 == 6, "zarr")
    return table(spark, d, "part").select("p_partkey", formats.reader(path, F.col("p_partkey") % 7 == 3, kind).alias("reader"))


@query("series_list", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 's2,s10' WHEN 1 THEN '0,1' ELSE '2,' || c_custkey + 2 END AS series FROM customer")
def series_list(spark, d):
    none, k = F.lit(None).cast("array<string>"), F.col("c_custkey") % 3
    listed = F.when(k == 0, F.array(F.lit("s10"), F.lit("s2"))).otherwise(none)
    folder = F.when(k == 1, F.array(F.lit("1"), F.lit("0"))).otherwise(none)
    groups = F.array((F.col("c_custkey") + 2).cast("string"), F.lit("OME"), F.lit("2"))
    return table(spark, d, "customer").select("c_custkey", F.array_join(formats.series(listed, folder, groups), ",").alias("series"))


@query("resolve_axis", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'BF' ELSE 'GFP' END AS coordinate FROM orders")
def resolve_axis(spark, d):
    k = F.col("o_orderkey") % 3
    known = F.when(k == 0, F.lit(None).cast("array<string>")).otherwise(F.array(F.lit("BF"), F.lit("GFP")))
    return table(spark, d, "orders").select("o_orderkey", formats.resolve_axis(F.when(k == 2, "GFP").otherwise("0"), known).alias("coordinate"))


@query("voxel_size", "SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_discount = 0 THEN 1.0::DOUBLE ELSE l_discount END AS size FROM lineitem")
def voxel_size(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", formats.voxel_size(F.col("l_discount")).alias("size"))


@query(
    "missing_volume",
    f"WITH {MOVIE_SQL} SELECT a.t AS t, b.c AS c, coalesce(value, -1) AS value, value IS NULL AS missing FROM Z, range(0, nt + 2) a(t), range(0, nc) b(c) LEFT JOIN V ON V.t = a.t AND V.c = b.c",
)
def missing_volume(spark, d):
    """Two hours more were planned than acquired."""
    sizes = movie_sizes(spark, d)
    return formats.with_missing_volumes(movie(spark, d), C.grid(spark, sizes | {"t": sizes["t"] + 2}), ["t", "c"], -1)


_WELL_META = """SELECT "row", "column", '{"ome":{"version":"0.5","well":{"images":[' || string_agg('{"path":"' || field || '"}', ',' ORDER BY CAST(field AS BIGINT)) || ']}}}' AS meta FROM P GROUP BY 1, 2"""


@query("dump_meta", f"WITH {PLATE_SQL} {_WELL_META}")
def dump_meta(spark, d):
    """The metadata of every well."""
    return H.well_metadata(plate(spark, d))


_PLATE_META = """W AS (SELECT "row", "column", count(*) AS n, CAST(regexp_extract("column", '[0-9]+$') AS BIGINT) AS k FROM P GROUP BY 1, 2), C AS (SELECT "row", "column", n, k, row_number() OVER (PARTITION BY "row" ORDER BY k) - 1 AS i FROM W)
SELECT "row" AS plate, '{"plate":{"rows":[{"name":"' || "row" || '"}],"columns":[' || string_agg('{"name":"' || "column" || '"}', ',' ORDER BY k) || '],"wells":[' ||
  string_agg('{"path":"' || "row" || '/' || "column" || '","rowIndex":0,"columnIndex":' || i || '}', ',' ORDER BY k) || '],"field_count":' || max(n) || ',"version":"0.4"}}' AS meta FROM C GROUP BY 1"""


@query("dump_plate_meta", f"WITH {PLATE_SQL}, {_PLATE_META}")
def dump_plate_meta(spark, d):
    """Each region as a plate of one row, in the older format, with the number of fields."""
    return H.plate_metadata(plate(spark, d).withColumn("plate", F.col("row")), ["plate"], "0.4", field_count=True)


@query("is_root", f'WITH {PLATE_SQL} SELECT DISTINCT "row" AS path FROM P')
def is_root(spark, d):
    """Nodes that hang on the root."""
    return H.nodes(plate(spark, d)).filter("parent = ''").select("path")


@query("array_keys", "SELECT page_id, CAST(page_id % 3 AS BIGINT) AS n_arrays FROM pages WHERE page_id % 3 > 0")
def array_keys(spark, d):
    """Arrays below each group: sorted names, groups without any left out."""
    count = (F.col("page_id") % 3).cast("int")
    rows = table(spark, d, "pages").filter(count > 0).select("page_id", F.explode(F.sequence(F.lit(1), count)).alias("name"))
    return rows.groupBy("page_id").agg(F.count("*").alias("n_arrays"))
