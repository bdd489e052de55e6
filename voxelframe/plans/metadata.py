"""Queries on hierarchies, plans of work, names and shapes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxelframe.functions import names, shapes
from voxelframe.operators import coords, shards, windows
from voxelframe.operators import hierarchy as H
from voxelframe.operators import images as I
from voxelframe.plans.inputs import MOVIE_SQL, PLATE_SQL, channels, movie, movie_sizes, plate, table
from voxelframe.plans.registry import query
from voxelframe.sources import acquisitions, archives, stores

# -- hierarchy ------------------------------------------------------------------------------


@query("hierarchy_positions", f'WITH {PLATE_SQL} SELECT "row", "column", field, path FROM P')
def hierarchy_positions(spark, d):
    return plate(spark, d)


_NODES = """, T AS (
  SELECT DISTINCT "row" AS path, '' AS parent, "row" AS name, 1 AS depth FROM P
  UNION SELECT DISTINCT "row" || '/' || "column", "row", "column", 2 FROM P
  UNION SELECT path, "row" || '/' || "column", field, 3 FROM P)"""


@query("tree", f"WITH {PLATE_SQL}{_NODES} SELECT path, parent, name, CAST(depth AS BIGINT) AS depth FROM T")
def tree(spark, d):
    return H.nodes(plate(spark, d))


@query("is_leaf", f"WITH {PLATE_SQL} SELECT path FROM P")
def is_leaf(spark, d):
    return H.leaves(H.nodes(plate(spark, d))).select("path")


@query("group_keys", f"WITH {PLATE_SQL}{_NODES} SELECT parent AS path, count(*) AS n_children, string_agg(name, ',' ORDER BY name) AS children FROM T GROUP BY parent")
def group_keys(spark, d):
    return H.children(H.nodes(plate(spark, d)))


@query("path_lookup", f"WITH {PLATE_SQL} SELECT DISTINCT \"row\" || '/' || \"column\" AS path, \"column\" AS name, CAST(2 AS BIGINT) AS depth FROM P WHERE \"row\" = 'ASIA' AND \"column\" = 'CHINA' OR \"row\" || '/' || \"column\" = (SELECT min(\"row\" || '/' || \"column\") FROM P)")
def path_lookup(spark, d):
    nodes = H.nodes(plate(spark, d))
    wells = nodes.filter("depth = 2")
    least = wells.agg(F.min("path")).first()[0] or ""
    return H.lookup(nodes, "/ASIA/CHINA").unionByName(H.lookup(nodes, least)).select("path", "name", "depth").distinct()


@query("contains_key", "SELECT c_custkey, c_nationkey IN (SELECT s_nationkey FROM supplier) AS present FROM customer")
def contains_key(spark, d):
    wanted = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("key"))
    return H.contains(table(spark, d, "supplier").select(F.col("s_nationkey").alias("key")), wanted, ["key"]).select("c_custkey", "present")


@query("tree_levels", f"WITH {PLATE_SQL}{_NODES} SELECT path, row_number() OVER (PARTITION BY parent ORDER BY regexp_replace(name, '[0-9]+$', ''), CAST(nullif(regexp_extract(name, '[0-9]+$'), '') AS BIGINT)) AS n FROM T WHERE depth <= 2")
def tree_levels(spark, d):
    """The tree down to wells, siblings numbered in natural order."""
    w = Window.partitionBy("parent").orderBy("order")
    return H.tree(H.nodes(plate(spark, d)), 2).select("path", F.row_number().over(w).cast("long").alias("n"))


@query(
    "create_plate",
    """WITH T AS (SELECT s_nationkey AS well, CAST(s_suppkey AS VARCHAR) AS name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i FROM supplier),
W AS (SELECT DISTINCT c_nationkey AS well, CAST(c_custkey AS VARCHAR) AS name FROM customer),
X AS (SELECT W.*, row_number() OVER (PARTITION BY well ORDER BY name) - 1 AS n FROM W WHERE (well, name) NOT IN (SELECT well, name FROM T))
SELECT well, name, CAST(i AS BIGINT) AS index FROM T UNION ALL SELECT well, name, CAST(n + coalesce((SELECT max(i) + 1 FROM T WHERE T.well = X.well), 0) AS BIGINT) FROM X""",
)
def create_plate(spark, d):
    """Positions created where they are missing; those there keep their place."""
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    there = table(spark, d, "supplier").select(F.col("s_nationkey").alias("well"), F.col("s_suppkey").cast("string").alias("name"), (F.row_number().over(w) - 1).cast("long").alias("index"))
    wanted = table(spark, d, "customer").select(F.col("c_nationkey").alias("well"), F.col("c_custkey").cast("string").alias("name"))
    return H.create_or_append(there, wanted.unionByName(wanted), ["well"], "name")


@query("delete_node", f"WITH {PLATE_SQL}{_NODES} SELECT path FROM T WHERE path <> (SELECT min(\"row\") FROM P) AND NOT starts_with(path, (SELECT min(\"row\") FROM P) || '/')")
def delete_node(spark, d):
    p = plate(spark, d)
    return H.delete(H.nodes(p), p.agg(F.min("row")).first()[0] or "").select("path")


_SUMMARY = f'WITH {PLATE_SQL} SELECT "row", count(DISTINCT "column") AS n_wells, count(*) AS n_positions, CAST(sum(8 * length(path)) AS BIGINT) AS nbytes FROM P GROUP BY "row"'


@query("plate_summary", _SUMMARY)
def plate_summary(spark, d):
    return H.summary(plate(spark, d).withColumn("nbytes", (F.length("path") * 8).cast("long")), ["row"])


@query("field_count", f'WITH {PLATE_SQL} SELECT "row", "column", count(*) AS n FROM P GROUP BY 1, 2')
def field_count(spark, d):
    return plate(spark, d).groupBy("row", "column").agg(F.count("*").alias("n"))


@query("first_position", f'WITH {PLATE_SQL} SELECT "row", arg_min(path, CAST(field AS BIGINT)) AS path FROM P GROUP BY 1')
def first_position(spark, d):
    return H.first_position(plate(spark, d).withColumn("ordinal", F.col("field").cast("long")), ["row"])


@query("positions_to_create", "SELECT c_nationkey, c_custkey FROM customer WHERE (c_nationkey, c_custkey) NOT IN (SELECT s_nationkey, s_suppkey FROM supplier)")
def positions_to_create(spark, d):
    there = table(spark, d, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), F.col("s_suppkey").alias("c_custkey"))
    return H.missing(table(spark, d, "customer").select("c_nationkey", "c_custkey"), there, ["c_nationkey", "c_custkey"])


@query("create_positions", "SELECT c_nationkey AS well, c_custkey AS field FROM customer UNION SELECT s_nationkey, s_suppkey FROM supplier")
def create_positions(spark, d):
    there = table(spark, d, "supplier").select(F.col("s_nationkey").alias("well"), F.col("s_suppkey").alias("field"))
    wanted = table(spark, d, "customer").select(F.col("c_nationkey").alias("well"), F.col("c_custkey").alias("field"))
    return there.unionByName(H.missing(wanted, there, ["well", "field"]).distinct())


@query("channels_to_append", "SELECT DISTINCT c_mktsegment AS name FROM customer WHERE c_mktsegment <> 'BUILDING'")
def channels_to_append(spark, d):
    there = spark.createDataFrame([("BUILDING",)], "name string")
    return H.missing(table(spark, d, "customer").select(F.col("c_mktsegment").alias("name")).distinct(), there, ["name"])


@query(
    "next_index",
    """WITH I AS (SELECT s_nationkey AS k, CAST(s_suppkey AS VARCHAR) AS name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i FROM supplier),
W AS (SELECT c_nationkey AS k, CAST(c_custkey AS VARCHAR) AS name FROM customer),
J AS (SELECT W.k, W.name, I.i, (SELECT max(i) FROM I x WHERE x.k = W.k) AS top FROM W LEFT JOIN I ON W.k = I.k AND W.name = I.name)
SELECT k, name, CAST(coalesce(i, coalesce(top, -1) + row_number() OVER (PARTITION BY k, i IS NULL ORDER BY name)) AS BIGINT) AS index FROM J""",
)
def next_index(spark, d):
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    items = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").cast("string").alias("name"), (F.row_number().over(w) - 1).alias("index"))
    wanted = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").cast("string").alias("name"))
    return H.next_index(items, wanted, ["k"])


@query("unique_check", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique_check(spark, d):
    return H.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "metadata_precedence",
    """WITH A AS (SELECT user_id AS position, event_type AS key, event_id AS source, CAST(value * 100 AS BIGINT) AS v FROM events),
F AS (SELECT *, row_number() OVER (PARTITION BY position, key ORDER BY source) AS n FROM A)
SELECT position, key, source FROM F WHERE n = 1 AND position NOT IN (SELECT s_suppkey FROM supplier)""",
)
def metadata_precedence(spark, d):
    sources = table(spark, d, "events").select(F.col("user_id").alias("position"), F.col("event_type").alias("key"), F.col("event_id").alias("source"))
    existing = table(spark, d, "supplier").select(F.col("s_suppkey").alias("position"), F.explode(F.array(*[F.lit(r) for r in channels(spark, d)])).alias("key"))
    return H.metadata_to_write(sources, existing).select("position", "key", "source")


@query("reserved_keys", "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'ome' WHEN 1 THEN 'omero' ELSE 'version' END AS key FROM customer WHERE c_custkey % 5 IN (0, 1, 3)")
def reserved_keys(spark, d):
    """Attributes that users may not write, among others that they may."""
    listed = F.array(*[F.lit(k) for k in ("ome", "omero", "Omero", "version", "notes")])
    return I.refused_keys(table(spark, d, "customer").select("c_custkey", F.element_at(listed, (F.col("c_custkey") % 5 + 1).cast("int")).alias("key")), "key")


@query("rename_well", "SELECT n_name AS old_path, CASE WHEN n_regionkey = 0 THEN 'B/' || n_nationkey ELSE n_name END AS path FROM nation")
def rename_well(spark, d):
    nation = table(spark, d, "nation")
    mapping = nation.filter("n_regionkey = 0").select(F.col("n_name").alias("old"), F.concat(F.lit("B/"), F.col("n_nationkey").cast("string")).alias("new"))
    return H.rename_wells(nation.select(F.col("n_name").alias("path")), mapping)


@query("merge_stores", "SELECT 's' AS store, s_name AS name FROM supplier UNION ALL SELECT 'c', c_name FROM customer")
def merge_stores(spark, d):
    one = table(spark, d, "supplier").select(F.lit("s").alias("store"), F.col("s_name").alias("name"))
    return one.unionByName(table(spark, d, "customer").select(F.lit("c").alias("store"), F.col("c_name").alias("name")))


@query(
    "detect_layout",
    "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'hcs' WHEN 1 THEN 'bf2raw' WHEN 2 THEN 'fov' END AS layout, CASE n_nationkey % 3 WHEN 0 THEN '0.5' ELSE '0.4' END AS version FROM nation",
)
def detect_layout(spark, d):
    k = F.col("n_nationkey") % 4
    keys = F.when(k == 0, F.array(F.lit("plate"), F.lit("multiscales"))).when(k == 1, F.array(F.lit("multiscales"), F.lit("bioformats2raw.layout"))).when(k == 2, F.array(F.lit("multiscales"))).otherwise(F.array(F.lit("notes")))
    nested = F.when(F.col("n_nationkey") % 3 == 0, "0.5")
    return table(spark, d, "nation").select("n_nationkey", H.layout(keys).alias("layout"), H.version(nested, F.lit(None).cast("string")).alias("version"))


# -- order ----------------------------------------------------------------------------------


@query("time_delta", "SELECT event_id, date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS delta FROM events")
def time_delta(spark, d):
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    rows = table(spark, d, "events").withColumn("us", micros)
    return windows.differences(rows, ["user_id"], ["ts", "event_id"], "us").select("event_id", "delta")


@query("z_step", "SELECT conv_id, abs(b - a) AS step FROM (SELECT conv_id, turn, CAST(length(text) AS DOUBLE) AS a, lead(CAST(length(text) AS DOUBLE)) OVER w AS b, row_number() OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE n = 1")
def z_step(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").cast("double").alias("z"))
    return windows.step(rows, ["conv_id"], "turn", "z")


@query(
    "contiguous_runs",
    f"WITH {MOVIE_SQL}, R AS (SELECT c, t, t - row_number() OVER (PARTITION BY c ORDER BY t) AS g FROM V) SELECT c, min(t) AS \"start\", max(t) + 1 AS stop, count(*) AS n FROM R GROUP BY c, g",
)
def contiguous_runs(spark, d):
    return windows.contiguous_runs(movie(spark, d), ["c"], "t")


@query("stage_grid", "SELECT p_partkey, (n - 1) // 10 AS grid_row, (n - 1) % 10 AS grid_column FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_retailprice, p_partkey) AS n FROM part)")
def stage_grid(spark, d):
    place = F.struct("p_retailprice", "p_partkey")
    return windows.stage_grid(table(spark, d, "part").withColumn("x", place), ["p_brand"], F.lit(10), "p_size", "x").select("p_partkey", "grid_row", "grid_column")


_ENTRIES = """A AS (SELECT l_orderkey AS archive, 'd' || l_linenumber || CASE WHEN l_linenumber % 2 = 0 THEN '/zarr.json' ELSE '/c' END AS name,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS ordinal FROM lineitem)"""


def _entries(spark, d):
    li = table(spark, d, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    name = F.concat(F.lit("d"), F.col("l_linenumber").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, "/zarr.json").otherwise("/c"))
    return li.select(F.col("l_orderkey").alias("archive"), name.alias("name"), F.row_number().over(w).cast("long").alias("ordinal"))


@query("zip_dedupe", f"WITH {_ENTRIES} SELECT archive, name, max(ordinal) AS ordinal FROM A GROUP BY 1, 2")
def zip_dedupe(spark, d):
    return archives.unpack(_entries(spark, d), ["archive"])


@query("zip_summary", f"WITH {_ENTRIES} SELECT archive, count(*) AS n_entries, count(*) FILTER (WHERE name LIKE '%zarr.json') AS n_metadata, count(*) - count(DISTINCT name) AS n_duplicates FROM A GROUP BY 1")
def zip_summary(spark, d):
    return archives.summary(_entries(spark, d), ["archive"])


@query("zip_comment", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN '0.5' END AS version, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS json_first FROM orders")
def zip_comment(spark, d):
    """What archive comments tell; every third archive has another kind of comment."""
    k = F.col("o_orderkey") % 3
    said = F.format_string('{"ome": {"version": "0.5", "zipFile": {"centralDirectory": {"jsonFirst": %s}}}}', F.when(k == 0, "true").otherwise("false"))
    comment = F.when(k == 2, "made by hand").otherwise(said)
    return table(spark, d, "orders").select("o_orderkey", archives.comment_fields(comment).alias("f")).select("o_orderkey", "f.version", "f.json_first")


@query(
    "bfs_order",
    f"WITH {_ENTRIES} SELECT archive, name, ordinal, row_number() OVER (PARTITION BY archive ORDER BY CASE WHEN name LIKE '%zarr.json' THEN 0 ELSE 1 END, CASE WHEN name LIKE '%zarr.json' THEN name END, ordinal) - 1 AS position FROM A",
)
def bfs_order(spark, d):
    return archives.pack_order(_entries(spark, d), ["archive"])


@query("natural_sort", "SELECT s_nationkey, name, row_number() OVER (PARTITION BY s_nationkey ORDER BY k) AS n FROM (SELECT s_nationkey, 'Supplier#' || s_suppkey AS name, s_suppkey AS k FROM supplier)")
def natural_sort(spark, d):
    rows = table(spark, d, "supplier").select("s_nationkey", F.concat(F.lit("Supplier#"), F.col("s_suppkey").cast("string")).alias("name"))
    w = Window.partitionBy("s_nationkey").orderBy(names.natural_key(F.col("name")))
    return rows.select("s_nationkey", "name", F.row_number().over(w).cast("long").alias("n"))


@query("lex_sort_keys", "SELECT s_nationkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) AS n FROM supplier")
def lex_sort_keys(spark, d):
    return windows.numbered(table(spark, d, "supplier").select("s_nationkey", "s_name"), ["s_nationkey"], ["s_name"])


@query("plane_key_order", "SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY contains(o_orderpriority, '-'), o_orderpriority) AS n FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders)")
def plane_key_order(spark, d):
    """The metadata keys of each plane, those with a dash after the others."""
    keys = table(spark, d, "orders").select("o_custkey", "o_orderpriority").distinct()
    return windows.numbered(keys, ["o_custkey"], [names.plane_key(F.col("o_orderpriority"))])


# -- plans of work --------------------------------------------------------------------------


@query("shard_batches", f"WITH {MOVIE_SQL} SELECT c, t // 10 AS shard, string_agg(DISTINCT CAST(t AS VARCHAR), ',' ORDER BY CAST(t AS VARCHAR)) AS indices FROM V GROUP BY 1, 2")
def shard_batches(spark, d):
    out = shards.shard_batches(movie(spark, d), ["c"], "t", 10)
    return out.select("c", "shard", F.array_join(F.array_sort(F.transform("indices", lambda i: i.cast("string"))), ",").alias("indices"))


@query("covered_cells", f"WITH {MOVIE_SQL} SELECT c, t // 10 AS shard, count(DISTINCT t) = least((t // 10 + 1) * 10, (SELECT nt FROM Z)) - (t // 10) * 10 AS owned FROM V GROUP BY c, t // 10")
def covered_cells(spark, d):
    return shards.covered_cells(movie(spark, d), ["c"], "t", 10, F.lit(movie_sizes(spark, d)["t"]))


@query(
    "plan_unit",
    f"WITH {MOVIE_SQL}, O AS (SELECT c, t // 2 AS shard, count(DISTINCT t) = least((t // 2 + 1) * 2, (SELECT nt FROM Z)) - (t // 2) * 2 AS owned FROM V GROUP BY c, t // 2)"
    " SELECT c, shard // 3 AS unit, CAST(count(*) * 4 AS BIGINT) AS n_shards FROM O GROUP BY 1, 2 HAVING bool_and(owned)",
)
def plan_unit(spark, d):
    """Units of six hours of a channel that own every shard they touch; each shard is four in space."""
    owned = shards.covered_cells(movie(spark, d), ["c"], "t", 2, F.lit(movie_sizes(spark, d)["t"]))
    units = owned.groupBy("c", F.floor(F.col("shard") / 3).cast("long").alias("unit"))
    return units.agg(F.bool_and("owned").alias("all"), (F.count("*") * 4).alias("n_shards")).filter("all").drop("all")


@query("unit_cross_product", "SELECT n_nationkey, CAST(c AS BIGINT) AS c_in, CAST(c + 10 AS BIGINT) AS c_out, CAST(t AS BIGINT) AS t_in, CAST(t * 2 AS BIGINT) AS t_out FROM nation, range(0, 3) a(c), range(0, 4) b(t)")
def unit_cross_product(spark, d):
    seq = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    c, t = seq(3), seq(4)
    return shards.unit_product(table(spark, d, "nation"), ["n_nationkey"], c, F.transform(c, lambda x: x + 10), t, F.transform(t, lambda x: x * 2))


@query(
    "batch_match",
    """WITH R AS (SELECT o_custkey AS k, CAST(o_orderkey % 7 AS BIGINT) AS i, o_orderkey AS partner FROM orders), F AS (SELECT k, i, min(partner) AS partner FROM R GROUP BY 1, 2)
SELECT k, i AS index, i // 3 AS batch, partner FROM F""",
)
def batch_match(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 7).alias("index"), F.col("o_orderkey").alias("partner"), F.col("o_orderkey").alias("place"))
    batches = o.select("k", "index", F.floor(F.col("index") / 3).cast("long").alias("batch")).distinct()
    return shards.match_batches(o, batches, ["k"]).select("k", "index", "batch", "partner")


@query(
    "unit_resume",
    """WITH R AS (SELECT DISTINCT l_orderkey AS unit, l_linenumber AS shard FROM lineitem WHERE l_returnflag <> 'R'), S AS (SELECT DISTINCT l_orderkey AS unit, l_linenumber AS shard FROM lineitem),
B AS (SELECT coalesce(R.unit, S.unit) AS unit, R.unit IS NOT NULL AND S.unit IS NOT NULL AS same FROM R FULL JOIN S ON R.unit = S.unit AND R.shard = S.shard)
SELECT o_orderkey AS unit, coalesce((SELECT bool_and(same) FROM B WHERE B.unit = o_orderkey), false) AS complete FROM (SELECT DISTINCT o_orderkey FROM orders)""",
)
def unit_resume(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("unit"), F.col("l_linenumber").alias("shard"), "l_returnflag")
    stored, recorded = li.select("unit", "shard").distinct(), li.filter("l_returnflag <> 'R'").select("unit", "shard").distinct()
    return shards.complete_units(recorded, stored, table(spark, d, "orders").select(F.col("o_orderkey").alias("unit")))


@query("unit_name", "SELECT o_orderkey, substr(sha256(CAST(o_orderkey % 13 AS VARCHAR) || '|' || CAST(o_custkey AS VARCHAR) || '|' || o_orderstatus), 1, 12) AS name FROM orders")
def unit_name(spark, d):
    return table(spark, d, "orders").select("o_orderkey", shards.unit_name(F.col("o_orderkey") % 13, F.col("o_custkey"), F.col("o_orderstatus")).alias("name"))


@query("distinct_indices", "SELECT DISTINCT l_suppkey AS i FROM lineitem")
def distinct_indices(spark, d):
    return windows.distinct_indices(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("i")), "i")


# -- names ----------------------------------------------------------------------------------


@query("channel_color", "SELECT p_partkey, CASE WHEN p_name LIKE '%GFP%' THEN '00FF00' WHEN k = 1 THEN 'FF00FF' WHEN k = 2 THEN '0000FF' WHEN k = 3 THEN 'FFFF00' WHEN k = 4 THEN 'FFA500' WHEN k = 5 THEN '00FF00' ELSE 'FFFFFF' END AS color FROM (SELECT *, p_partkey % 7 AS k FROM part)")
def channel_color(spark, d):
    tags = F.array(*[F.lit(t) for t in ("", " mCherry EX561", "DAPI", "x Cy3", "Cy5-640", "GFP and TXR", "State0")])
    name = F.concat(F.lit("c "), F.element_at(tags, (F.col("p_partkey") % 7 + 1).cast("int")))
    return table(spark, d, "part").select("p_partkey", names.channel_color(name).alias("color"))


@query("display_window", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN -0.2::DOUBLE ELSE 0.0::DOUBLE END AS \"start\", CASE n_nationkey % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 0.2::DOUBLE ELSE 65535.0::DOUBLE END AS \"end\" FROM nation")
def display_window(spark, d):
    name = F.element_at(F.array(F.lit("BF"), F.lit("Phase3D"), F.lit("GFP")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    return table(spark, d, "nation").select("n_nationkey", names.display_window(name).alias("w")).select("n_nationkey", "w.start", "w.end")


@query(
    "parse_well_label",
    """SELECT s_suppkey, CASE WHEN k = 0 THEN 'C' ELSE '0' END AS "row", CASE WHEN k = 0 THEN CAST(s_nationkey AS VARCHAR) ELSE CAST(s_suppkey AS VARCHAR) END AS "column",
CASE k WHEN 0 THEN CAST(s_suppkey AS VARCHAR) WHEN 1 THEN '007' || '012' WHEN 2 THEN '001000' ELSE '000005' END AS field FROM (SELECT *, s_suppkey % 4 AS k FROM supplier)""",
)
def parse_well_label(spark, d):
    k, n, s = F.col("s_suppkey") % 4, F.col("s_nationkey").cast("string"), F.col("s_suppkey").cast("string")
    label = (
        F.when(k == 0, F.concat(F.lit("C"), n, F.lit("-Site_"), s))
        .when(k == 1, F.concat(s, F.lit("-Pos007_012")))
        .when(k == 2, F.concat(s, F.lit("-Pos001")))
        .otherwise(F.concat(F.lit("Pos-"), s, F.lit("-000_005")))
    )
    return table(spark, d, "supplier").select("s_suppkey", names.well_label(label).alias("w")).select("s_suppkey", "w.row", "w.column", "w.field")


@query("normalize_path", "SELECT page_id, regexp_replace(regexp_replace(url, '/+', '/', 'g'), '/$', '') AS path FROM pages")
def normalize_path(spark, d):
    """URLs with a needless part and doubled or backward slashes, brought back to their plain form."""
    noisy = F.replace(F.concat(F.replace("url", F.lit("/"), F.lit("//")), F.lit("/./")), F.lit("//"), F.lit("\\/"))
    return table(spark, d, "pages").select("page_id", names.normal_path(noisy).alias("path"))


@query(
    "size_format",
    """SELECT o_orderkey, CASE WHEN n < 1024 THEN CAST(n AS VARCHAR) || ' B' WHEN n / 1024.0 < 1024 THEN printf('%.1f KiB', CAST(n AS DOUBLE) / 1024) WHEN n / 1048576.0 < 1024 THEN printf('%.1f MiB', CAST(n AS DOUBLE) / 1048576)
ELSE printf('%.1f GiB', CAST(n AS DOUBLE) / 1073741824) END AS size FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * CAST(pow(10, o_orderkey % 5) AS BIGINT) // 100 AS n FROM orders)""",
)
def size_format(spark, d):
    n = F.floor(F.floor("o_totalprice") * F.pow(F.lit(10), F.col("o_orderkey") % 5).cast("long") / 100).cast("long")
    return table(spark, d, "orders").select("o_orderkey", names.size_text(n).alias("size"))


@query("meta_key_glob", "SELECT DISTINCT event_type AS key FROM events WHERE regexp_matches(event_type, '^(.*i.*|p.*|[c-e].*)$')")
def meta_key_glob(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("key")).distinct().filter(names.matches_any(F.col("key"), ["*i*", "p*", "[c-e]*"], H.RESERVED_KEYS))


@query("validate_path", "SELECT page_id, regexp_matches(url, '^[a-zA-Z0-9]+$') AS fine, regexp_matches('A/' || page_id, '^\\w+/\\w+$') AS well FROM pages")
def validate_path(spark, d):
    return table(spark, d, "pages").select("page_id", names.valid_name(F.col("url")).alias("fine"), names.valid_well_path(F.concat(F.lit("A/"), F.col("page_id").cast("string"))).alias("well"))


@query("json_extract", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long", {"mode": "PERMISSIVE"})["k"].alias("k"))


@query("cc_index_line", "SELECT o_orderkey, CAST(o_orderkey % 100 AS BIGINT) AS t, CAST(o_custkey AS BIGINT) AS z FROM orders")
def cc_index_line(spark, d):
    line = F.format_string("%d\t%.4f\t%d, %d, %d", (F.col("o_orderkey") % 100).cast("long"), F.col("o_totalprice"), F.lit(64), F.lit(32), F.col("o_custkey"))
    return table(spark, d, "orders").select("o_orderkey", names.index_line(line).alias("s")).select("o_orderkey", "s.t", "s.z")


@query("label_colors", "SELECT label, CAST(label AS DOUBLE) * 20 / 255.0 AS red, 1.0::DOUBLE AS alpha FROM (SELECT DISTINCT label FROM embeddings)")
def label_colors(spark, d):
    labels = table(spark, d, "embeddings").select("label").distinct()
    rgba = names.label_rgba(F.array(F.col("label") * 20, F.lit(0), F.lit(255)))
    return labels.select("label", rgba.alias("c")).select("label", F.col("c")[0].alias("red"), F.col("c")[3].alias("alpha"))


# -- shapes ---------------------------------------------------------------------------------

_SHAPE = "(SELECT p_partkey, 2 AS t, 3 AS c, p_size * 40 AS z, 512 + p_size AS y, 100 * p_size AS x FROM part)"


def _shape(spark, d):
    size = F.col("p_size").cast("long")
    long = lambda n: F.lit(n).cast("long")
    return table(spark, d, "part").select("p_partkey", F.array(long(2), long(3), size * 40, 512 + size, 100 * size).alias("shape"))


def _zyx(rows, name):
    return rows.select("p_partkey", F.col(name)[2].alias("z"), F.col(name)[3].alias("y"), F.col(name)[4].alias("x"))


@query("default_chunks_v05", f"SELECT p_partkey, CAST(least(16, z) AS BIGINT) AS z, CAST(least(256, y) AS BIGINT) AS y, CAST(least(256, x) AS BIGINT) AS x FROM {_SHAPE}")
def default_chunks_v05(spark, d):
    return _zyx(_shape(spark, d).select("p_partkey", shapes.default_chunk(F.col("shape")).alias("s")), "s")


_HALVED = " ".join(f"WHEN z // 1 <= 1 OR CAST(ceil(z / {2**k}.0) AS BIGINT) * y * x * 4 <= 500000000 THEN CAST(ceil(z / {2**k}.0) AS BIGINT)" for k in range(12))


@query("default_chunks_v04", f"SELECT p_partkey, CASE {_HALVED} END AS z, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x FROM {_SHAPE}")
def default_chunks_v04(spark, d):
    return _zyx(_shape(spark, d).select("p_partkey", shapes.limited_chunk(F.col("shape"), F.lit(4)).alias("s")), "s")


@query("convert_chunks", f"SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE (CASE {_HALVED} END) END AS z, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x FROM {_SHAPE}")
def convert_chunks(spark, d):
    request = F.when(F.col("p_partkey") % 2 == 0, "xy").otherwise("XYZ")
    return _zyx(_shape(spark, d).select("p_partkey", shapes.requested_chunk(request, F.col("shape"), F.lit(4)).alias("s")), "s")


@query("default_shards", f"SELECT p_partkey, CAST(ceil(z / CAST(least(16, z) AS DOUBLE)) AS BIGINT) AS z, CAST(ceil(y / CAST(least(256, y) AS DOUBLE)) AS BIGINT) AS y, CAST(ceil(x / CAST(least(256, x) AS DOUBLE)) AS BIGINT) AS x FROM {_SHAPE}")
def default_shards(spark, d):
    return _zyx(_shape(spark, d).select("p_partkey", shapes.default_shards(F.col("shape"), shapes.default_chunk(F.col("shape"))).alias("s")), "s")


@query("clamp_chunks", f"SELECT p_partkey, CAST(least(64, z) AS BIGINT) AS z, CAST(least(600, y) AS BIGINT) AS y, CAST(least(1000, x) AS BIGINT) AS x FROM {_SHAPE}")
def clamp_chunks(spark, d):
    wanted = F.array(*[F.lit(n).cast("long") for n in (1, 1, 64, 600, 1000)])
    return _zyx(_shape(spark, d).select("p_partkey", shapes.clamp(wanted, F.col("shape")).alias("s")), "s")


@query("nbytes", f"SELECT p_partkey, CAST(t AS BIGINT) * c * z * y * x * 2 AS nbytes FROM {_SHAPE}")
def nbytes(spark, d):
    return _shape(spark, d).select("p_partkey", shapes.n_bytes(F.col("shape"), F.lit(2)).alias("nbytes"))


@query("pad_shape", f"SELECT p_partkey, CAST(1 AS BIGINT) AS t, CAST(1 AS BIGINT) AS c, CAST(z AS BIGINT) AS z FROM {_SHAPE}")
def pad_shape(spark, d):
    padded = _shape(spark, d).select("p_partkey", shapes.pad_shape(F.slice("shape", 3, 3), 5).alias("s"))
    return padded.select("p_partkey", F.col("s")[0].alias("t"), F.col("s")[1].alias("c"), F.col("s")[2].alias("z"))


query("dim_sizes", f"SELECT p_partkey, CAST(t AS BIGINT) AS frames, CAST(c AS BIGINT) AS channels, CAST(z AS BIGINT) AS slices, CAST(y AS BIGINT) AS height, CAST(x AS BIGINT) AS width FROM {_SHAPE}")(
    lambda spark, d: _shape(spark, d).select("p_partkey", *[F.col("shape")[k].alias(n) for k, n in enumerate(("frames", "channels", "slices", "height", "width"))])
)


@query("ceil_div", "SELECT l_orderkey, l_partkey, CAST(ceil(l_partkey / 7.0) AS BIGINT) AS n FROM lineitem")
def ceil_div(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", shapes.ceil_div(F.col("l_partkey"), 7).alias("n"))


@query("slice_to_list", "SELECT n_nationkey, CAST(i AS BIGINT) AS i FROM nation, LATERAL (SELECT unnest(range(n_regionkey, n_nationkey, 3)) AS i)")
def slice_to_list(spark, d):
    start, stop = F.col("n_regionkey").cast("long"), F.col("n_nationkey").cast("long")
    return table(spark, d, "nation").select("n_nationkey", F.explode(shapes.slice_indices(start, stop, 3)).alias("i"))


@query("missing_axes", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'C' ELSE 'T,Z' END AS missing FROM nation")
def missing_axes(spark, d):
    lists = (("time", "c", "z", "Y", "x"), ("time", "z", "y", "x"), ("channels", "Y", "X"))
    axes = F.element_at(F.array(*[F.array(*[F.lit(a) for a in x]) for x in lists]), (F.col("n_nationkey") % 3 + 1).cast("int"))
    return table(spark, d, "nation").select("n_nationkey", F.array_join(shapes.missing_axes(axes), ",").alias("missing"))


@query("axis_index", "SELECT n_nationkey, CAST(n_nationkey % 5 AS BIGINT) AS i FROM nation")
def axis_index(spark, d):
    axes = F.array(*[F.lit(a) for a in "tczyx"])
    asked = F.element_at(F.array(*[F.lit(a) for a in "TcZyX"]), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return table(spark, d, "nation").select("n_nationkey", shapes.axis_index(axes, asked).alias("i"))


@query("valid_units", "SELECT n_nationkey, n_nationkey % 4 IN (0, 3) AS fine FROM nation")
def valid_units(spark, d):
    k = F.col("n_nationkey") % 4
    kind = F.when(k < 2, "space").when(k == 2, "time").otherwise("channel")
    unit = F.when(k == 0, "micrometer").when(k == 1, "second").when(k == 2, "meter").otherwise("anything")
    return table(spark, d, "nation").select("n_nationkey", coords.valid_unit(kind, unit).alias("fine"))


@query("parse_dims", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'z,y' END AS dims FROM nation")
def parse_dims(spark, d):
    text = F.when(F.col("n_nationkey") % 2 == 0, " Z, y").otherwise("z,q")
    return table(spark, d, "nation").select("n_nationkey", F.array_join(shapes.parse_dims(text), ",").alias("dims"))


@query("page_index", f"WITH {MOVIE_SQL} SELECT t, c, t * (SELECT nc FROM Z) + c AS page FROM V")
def page_index(spark, d):
    sizes = movie_sizes(spark, d)
    return movie(spark, d).select("t", "c", shapes.flat_index([F.col("t"), F.col("c")], [sizes["t"], sizes["c"]]).alias("page"))


@query(
    "channel_fallback",
    "SELECT image, i AS \"index\", CASE WHEN i % 2 = 0 THEN name ELSE CAST(i AS VARCHAR) END AS name FROM (SELECT image, name, CAST(row_number() OVER (PARTITION BY image ORDER BY name) - 1 AS BIGINT) AS i"
    " FROM (SELECT DISTINCT c_nationkey AS image, c_mktsegment AS name FROM customer))",
)
def channel_fallback(spark, d):
    """Channels of which every second has no name."""
    rows = windows.numbered(table(spark, d, "customer").select(F.col("c_nationkey").alias("image"), F.col("c_mktsegment").alias("name")).distinct(), ["image"], ["name"])
    index = F.col("n") - 1
    return rows.select("image", index.alias("index"), names.channel_name(F.when(index % 2 == 0, F.col("name")), index).alias("name"))


# -- acquisitions ---------------------------------------------------------------------------


@query("cc_shape", f"WITH {MOVIE_SQL}, L AS (SELECT event_type, max(event_id) AS m, count(*) AS n FROM events GROUP BY 1) SELECT CAST(min(m) + 1 AS BIGINT) AS t, count(*) AS c, CAST(min(n) AS BIGINT) AS z, CAST(32 AS BIGINT) AS y, CAST(64 AS BIGINT) AS x FROM L")
def cc_shape(spark, d):
    e = table(spark, d, "events")
    n = e.groupBy("event_type").agg(F.count("*").alias("n"))
    line = F.format_string("%d\t%.2f\t64, 32, %d", F.col("event_id"), F.lit(0.25), F.col("n"))
    return acquisitions.shape(e.join(n, "event_type").select(F.col("event_type").alias("channel"), F.col("event_id").alias("ordinal"), line.alias("line")))


@query(
    "cc_metadata",
    """WITH R AS (SELECT event_type, event_id, event_id * 1000 AS ns, event_id % 8 AS v FROM events), D AS (SELECT *, ns - lag(ns) OVER (PARTITION BY event_type ORDER BY event_id) AS delta FROM R)
SELECT avg(CAST(v AS DOUBLE)) AS voxel_size_z, 0.25::DOUBLE AS voxel_size_y, 0.25::DOUBLE AS voxel_size_x, CAST(sum(delta) AS DOUBLE) / count(delta) / 1000000 AS time_delta_ms, arg_min(event_type, event_id) AS acquisition_type FROM D""",
)
def cc_metadata(spark, d):
    e = table(spark, d, "events")
    rows = e.select(
        F.col("event_type").alias("Channel"),
        (F.col("event_id") * 1000).alias("TimeStampInNanoSeconds"),
        F.col("event_type").alias("AcquisitionType"),
        F.lit(0.25).alias("VoxelDimX"),
        F.lit(0.25).alias("VoxelDimY"),
        (F.col("event_id") % 8).cast("double").alias("VoxelDimZ"),
        F.col("event_id").alias("ordinal"),
    )
    return acquisitions.summary(rows)


@query(
    "frame_metadata",
    "SELECT a.conv_id, a.turn, b.role FROM (SELECT DISTINCT conv_id, turn FROM conversations) a LEFT JOIN (SELECT * FROM conversations WHERE role <> 'assistant') b USING (conv_id, turn)",
)
def frame_metadata(spark, d):
    """Planes of which some have no metadata."""
    t = table(spark, d, "conversations")
    return I.frame_metadata(t.select("conv_id", "turn").distinct(), t.filter("role <> 'assistant'").select("conv_id", "turn", "role"), ["conv_id", "turn"])


_MM = """Y AS (SELECT o_orderkey, o_orderkey % 3 AS v, o_orderkey % 2 AS s, o_orderkey % 7 AS z, o_custkey FROM orders)"""


@query(
    "acquisition_summary",
    f"""WITH {_MM} SELECT o_orderkey, CASE v WHEN 0 THEN '2.0.1' WHEN 1 THEN '2.0.0-beta3' ELSE '1.4.22' END AS version,
CASE v WHEN 0 THEN 'a' || o_custkey || ',b' WHEN 1 THEN ',' ELSE '' END AS channels, CAST(o_custkey AS BIGINT) AS height, CAST(32 AS BIGINT) AS width,
CASE WHEN s = 0 OR z = 0 THEN 1.0::DOUBLE ELSE z * 0.25::DOUBLE END AS z_step, CASE WHEN s = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS t_step FROM Y""",
)
def acquisition_summary(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    version = F.when(k % 3 == 0, "2.0.1").when(k % 3 == 1, "2.0.0-beta3").otherwise("1.4.22")
    named = F.when(k % 3 == 0, F.concat(F.lit(',"ChNames":["a'), c, F.lit('","b"]'))).otherwise("")
    steps = F.when(k % 2 == 1, F.concat(F.lit(',"Interval_ms":500.0,"z-step_um":'), ((k % 7) * 0.25).cast("string"))).otherwise("")
    text = F.concat(F.lit('{"Summary":{"Channels":2,"Width":32,"MicroManagerVersion":"'), version, F.lit('","Height":'), c, named, steps, F.lit("}}"))
    out = acquisitions.acquisition_summary(table(spark, d, "orders").select("o_orderkey", text.alias("text")), ["o_orderkey"], "text")
    return out.withColumn("channels", F.array_join("channels", ","))


@query(
    "stage_positions",
    """SELECT c_custkey, CAST(p AS INTEGER) AS position, 'L' || p AS label, 'XY' AS device, CAST(c_custkey + p AS DOUBLE) AS first, CAST(CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 3 END AS INTEGER) AS n
FROM customer, range(0, 2) r(p) WHERE c_custkey % 3 = 2""",
)
def stage_positions(spark, d):
    """Stage positions of later versions (two axes) and of beta ones (three), of those acquisitions that have more than one."""
    k = F.col("c_custkey")
    later = lambda p: F.format_string('{"Label":"L%d","DevicePositions":[{"Device":"XY","Position_um":[%d,7.5]}]}', F.lit(p), k + p)
    beta = lambda p: F.format_string('{"label":"L%d","gridRow":0,"gridCol":0,"subpositions":[{"stageName":"XY","x":%d,"y":2,"z":1}]}', F.lit(p), k + p)
    listed = F.when(k % 2 == 0, F.concat_ws(",", later(0), later(1))).otherwise(F.concat_ws(",", beta(0), beta(1)))
    text = F.concat(F.lit('{"Summary":{"MicroManagerVersion":"'), F.when(k % 2 == 0, "2.0.1").otherwise("2.0 beta"), F.lit('","Positions":'), (k % 3).cast("string"), F.lit(',"StagePositions":['), listed, F.lit("]}}"))
    out = acquisitions.stage_positions(table(spark, d, "customer").select("c_custkey", text.alias("text")), ["c_custkey"], "text")
    return out.select("c_custkey", "position", "label", "device", F.col("values")[0].alias("first"), F.size("values").alias("n"))


@query(
    "version_walk",
    """WITH R AS (SELECT r_regionkey AS store, r_regionkey % 3 AS kind FROM region), C AS (SELECT n_regionkey AS store, min(n_nationkey) AS k FROM nation WHERE n_nationkey % 3 = 1 GROUP BY 1
), W AS (SELECT n_regionkey AS store, n_nationkey AS k, s_suppkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey, s_suppkey) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 2 = 1)
SELECT R.store, CASE kind WHEN 0 THEN '0.5' WHEN 1 THEN coalesce('0.' || C.k, '0.5') ELSE coalesce('0.' || W.s_suppkey, 'unknown') END AS version
FROM R LEFT JOIN C ON R.store = C.store LEFT JOIN W ON R.store = W.store AND W.n = 1""",
)
def version_walk(spark, d):
    """Versions of stores: some tell it at the root, series in a child, others two levels down in a well."""
    nation = table(spark, d, "nation")
    root = table(spark, d, "region").select(F.col("r_regionkey").alias("store"), F.lit("").alias("path"), (F.col("r_regionkey") % 3).alias("k"))
    told = F.when(F.col("k") == 0, '{"ome":{"version":"0.5"}}').when(F.col("k") == 1, '{"bioformats2raw.layout":3}').otherwise("{}")
    root = root.select("store", "path", F.lit(0).alias("depth"), F.lit(3).alias("format"), told.alias("attributes"))
    key = F.col("n_nationkey")
    version = lambda k: F.concat(F.lit('{"multiscales":[{},{"version":"0.'), k.cast("string"), F.lit('"}]}'))
    child = nation.select(F.col("n_regionkey").alias("store"), key.cast("string").alias("path"), F.lit(1).alias("depth"), F.lit(3).alias("format"), F.when(key % 3 == 1, version(key)).otherwise("{}").alias("attributes"))
    s = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == key)
    told = F.when(F.col("s_suppkey") % 2 == 1, F.concat(F.lit('{"well":{"version":"0.'), F.col("s_suppkey").cast("string"), F.lit('"}}'))).otherwise("{}")
    wells = s.select(F.col("n_regionkey").alias("store"), F.concat_ws("/", key.cast("string"), F.col("s_suppkey").cast("string")).alias("path"), F.lit(2).alias("depth"), F.lit(3).alias("format"), told.alias("attributes"))
    return stores.versions(root.unionByName(child).unionByName(wells), ["store"])


_LINES = """L AS (SELECT event_id, user_id, event_type, CASE event_id % 5 WHEN 0 THEN 'cut' WHEN 1 THEN 'text' END AS fault FROM events)"""


def _metadata_lines(spark, d):
    """A metadata line of each event; a fifth are cut off, and another have text for a number."""
    k = F.col("event_id")
    whole = F.concat(F.lit('{"Channel":"'), F.col("event_type"), F.lit('","Frame":'), F.when(k % 5 == 1, '"none"').otherwise(k.cast("string")), F.lit("}"))
    return table(spark, d, "events").select("event_id", F.when(k % 5 == 0, F.substr(whole, F.lit(1), F.length(whole) - 3)).otherwise(whole).alias("line"))


_WHOLE = """'{"Channel":"' || event_type || '","Frame":' || CASE fault WHEN 'text' THEN '"none"' ELSE CAST(event_id AS VARCHAR) END || '}'"""


@query("broken_lines", f"WITH {_LINES}, W AS (SELECT event_id, fault, {{_WHOLE}} AS w FROM L WHERE fault IS NOT NULL) SELECT event_id, CASE fault WHEN 'cut' THEN left(w, length(w) - 3) ELSE w END AS line FROM W".replace("{_WHOLE}", _WHOLE))
def broken_lines(spark, d):
    """What is set apart of metadata lines that can't be read."""
    return I.parted(_metadata_lines(spark, d), "line", "Channel string, Frame long")[1]


@query("planes_with_broken_metadata", f"WITH {_LINES} SELECT event_id, CASE WHEN fault IS NULL THEN event_type END AS channel, CASE WHEN fault IS NULL THEN event_id END AS frame FROM L")
def planes_with_broken_metadata(spark, d):
    """Every plane stays, with nulls where its metadata line is broken."""
    fine, _ = I.parted(_metadata_lines(spark, d), "line", "Channel string, Frame long")
    planes = table(spark, d, "events").select("event_id")
    return I.frame_metadata(planes, fine.select("event_id", F.col("metadata.Channel").alias("channel"), F.col("metadata.Frame").alias("frame")), ["event_id"])


_ASKED = f"(SELECT p_partkey, z AS nz, y AS ny, x AS nx, p_partkey % 60 + 1 AS z, 700 AS y, 300 AS x FROM {_SHAPE})"


@query(
    "convert_chunk_sizes",
    f"SELECT p_partkey, CAST(least(z, nz) AS BIGINT) AS z, CAST(least(y, ny) AS BIGINT) AS y, CAST(least(x, nx) AS BIGINT) AS x, (z > nz)::INT + (y > ny)::INT + (x > nx)::INT AS n_clamped FROM {_ASKED}",
)
def convert_chunk_sizes(spark, d):
    """Chunks asked for by five sizes, and on how many axes they were cut to the shape."""
    one = F.lit(1).cast("long")
    asked = F.array(one, one, (F.col("p_partkey") % 60 + 1).cast("long"), F.lit(700).cast("long"), F.lit(300).cast("long"))
    got = _shape(spark, d).select("p_partkey", shapes.chosen_chunk(asked, F.col("shape"), F.lit(4)).alias("g"))
    at = lambda k: F.col("g.chunk")[k]
    return got.select("p_partkey", at(2).alias("z"), at(3).alias("y"), at(4).alias("x"), F.size("g.clamped").alias("n_clamped"))
