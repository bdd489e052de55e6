"""Hierarchies, names, shapes and plans on closed-form cases."""

import pytest
from pyspark.sql import functions as F

from voxelframe.functions import names, shapes
from voxelframe.operators import hierarchy as H
from voxelframe.operators import shards, windows
from voxelframe.sources import acquisitions, archives


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def longs(*values):
    return F.array(*[F.lit(v).cast("long") for v in values]) if values else F.array().cast("array<long>")


@pytest.mark.parametrize(
    "label, want",
    [
        ("A1-Site_0", ("A", "1", "0")),
        ("H12-Site_1", ("H", "12", "1")),
        ("1-Pos000_000", ("0", "1", "000000")),
        ("2-Pos000_001", ("0", "2", "000001")),
        ("1-Pos001", ("0", "1", "001000")),
        ("Pos-5-000_005", ("0", "5", "000005")),
        ("xA1-Site_0", None),
        ("A1-Site_03x", ("A", "1", "03")),
        ("12-Pos7_008", ("0", "12", "7008")),
        ("Pos-5-000", None),
        ("A-Site_0", None),
        ("", None),
        ("A1_Site-0", None),
        ("A1_Site_0", None),
        ("Pos_5_000-005", None),
        ("Pos-5_000_005", None),
        ("1_Pos001", None),
        ("1-Pos001-005", ("0", "1", "001000")),
        ("1-Pos001x_5", ("0", "1", "001000")),
    ],
)
def test_well_labels(spark, label, want):
    got = one(spark, names.well_label(F.lit(label)))[0]
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize("n, want", [(3, "3 B"), (1023, "1023 B"), (int(2.234 * 2**20), "2.2 MiB"), (int(3.456 * 2**40), "3.5 TiB"), (2**50, None), (19712, "19.2 KiB")])
def test_sizes_as_text(spark, n, want):
    assert one(spark, names.size_text(F.lit(n)))[0] == want


@pytest.mark.parametrize("name, want", [("GFP", "00FF00"), ("GFP EX488 EM525-45", "00FF00"), ("S0", "FFFFFF"), ("TXR", "FF00FF"), ("RANDOM_CHANNEL", "FFFFFF"), ("GFP TXR", "00FF00")])
def test_channel_colors(spark, name, want):
    assert one(spark, names.channel_color(F.lit(name)))[0] == want


def test_display_windows(spark):
    assert tuple(one(spark, names.display_window(F.lit("BF")))[0]) == (0.0, 5.0, 0.0, 65535.0)
    assert tuple(one(spark, names.display_window(F.lit("any")))[0]) == (0.0, 65535.0, 0.0, 65535.0)


@pytest.mark.parametrize("path, want", [("a\\b//c/./d/", "a/b/c/d"), ("/a", "a"), ("", ""), ("a/../b", None), ("a..b", "a..b")])
def test_paths(spark, path, want):
    assert one(spark, names.normal_path(F.lit(path)))[0] == want


def test_natural_order(spark):
    given = ["f10", "f2", "f1a", "f1", "g0", "f02"]
    long = ["n" + "9" * 30, "n1" + "0" * 30, "n" + "9" * 29, "n" + "0" * 40 + "7"]
    assert [r["n"] for r in spark.createDataFrame([(n,) for n in long], "n string").orderBy(names.natural_key(F.col("n"))).collect()] == [long[3], long[2], long[0], long[1]]
    out = spark.createDataFrame([(n,) for n in given], "n string").orderBy(names.natural_key(F.col("n")), "n").collect()
    assert [r["n"] for r in out] == ["f1", "f1a", "f02", "f2", "f10", "g0"]


def test_globs(spark):
    rows = spark.createDataFrame([(k,) for k in ("omero", "notes-x", "notes.y", "a1", "A1")], "k string")
    assert {r["k"] for r in rows.filter(names.matches_any(F.col("k"), ["notes-*", "[a-c]?", "o*"], H.RESERVED_KEYS)).collect()} == {"notes-x", "a1"}


def test_label_rgba(spark):
    rows = spark.createDataFrame([([255, 0, 51],), ([1, 2, 3, 4],), ([256, 0, 0],)], "c array<int>")
    got = [r[0] for r in rows.select(names.label_rgba(F.col("c"))).collect()]
    assert got[0] == [1.0, 0.0, 0.2, 1.0] and got[1][3] == 4 / 255 and got[2] is None


@pytest.mark.parametrize("axes, want", [(["T", "C", "Z", "Y", "X"], []), (["time", "z", "y", "x"], ["C"]), (["channels", "Y", "X"], ["T", "Z"])])
def test_missing_axes(spark, axes, want):
    assert one(spark, shapes.missing_axes(F.array(*[F.lit(a) for a in axes])))[0] == want


@pytest.mark.parametrize(
    "shape, want",
    [
        ((2, 2, 64, 1024, 1024), (1, 1, 16, 256, 256)),
        ((2, 2, 8, 1024, 1024), (1, 1, 8, 256, 256)),
        ((2, 2, 64, 128, 200), (1, 1, 16, 128, 200)),
        ((1, 1, 4, 32, 32), (1, 1, 4, 32, 32)),
    ],
)
def test_default_chunks(spark, shape, want):
    assert tuple(one(spark, shapes.default_chunk(longs(*shape)))[0]) == want


def test_chunk_limits(spark):
    got = one(spark, shapes.limited_chunk(longs(1, 1, 256, 1024, 1024), F.lit(4)))[0]
    assert got[2] * 1024 * 1024 * 4 <= shapes.MAX_CHUNK_BYTES < 2 * got[2] * 1024 * 1024 * 4
    assert one(spark, shapes.default_shards(longs(5, 2, 33, 300, 512), longs(1, 1, 16, 256, 256)))[0] == [1, 1, 3, 2, 2]
    assert one(spark, shapes.requested_chunk(F.lit("xy"), longs(5, 2, 33, 300, 512), F.lit(2)))[0] == [1, 1, 1, 300, 512]
    assert one(spark, shapes.requested_chunk(F.lit("zz"), longs(5, 2, 33, 300, 512), F.lit(2)))[0] is None
    for z, asked, want in ((15, 10, 10), (7, 5, 5), (16, 8, 8), (100, 50, 50), (9, 4, 4), (5, 10, 5)):
        assert one(spark, shapes.clamp(longs(asked), longs(z)))[0] == [want]


def test_small_shapes(spark):
    assert one(spark, shapes.pad_shape(longs(4, 8), 5))[0] == [1, 1, 1, 4, 8]
    assert one(spark, shapes.parse_dims(F.lit("Z, y")))[0] == ["z", "y"] and one(spark, shapes.parse_dims(F.lit("q")))[0] is None
    assert one(spark, shapes.slice_indices(F.lit(1).cast("long"), F.lit(6).cast("long"), 2))[0] == [1, 3, 5]
    assert one(spark, shapes.slice_indices(F.lit(3).cast("long"), F.lit(3).cast("long")))[0] == []
    assert one(spark, shapes.flat_index([F.lit(1), F.lit(2)], [4, 5]))[0] == 7


@pytest.mark.parametrize("indices, runs", [([], 0), ([3], 1), ([0, 1, 2, 3, 4], 1), ([0, 3, 4], 2), ([0, 2, 4], 3), ([5, 6, 9], 2)])
def test_contiguous_runs(spark, indices, runs):
    rows = spark.createDataFrame([(0, i) for i in indices], "k int, i long")
    out = windows.contiguous_runs(rows, ["k"], "i").collect()
    assert len(out) == runs and sorted(i for r in out for i in range(r["start"], r["stop"])) == indices


def test_shard_ownership(spark):
    rows = spark.createDataFrame([("all", i) for i in range(10)] + [("tail", i) for i in (20, 21, 22)] + [("two", i) for i in (0, 1)] + [("over", i) for i in range(11)], "k string, i long")
    out = {(r["k"], r["shard"]): r["owned"] for r in shards.covered_cells(rows, ["k"], "i", 10, F.lit(23)).collect()}
    assert out == {("all", 0): True, ("tail", 2): True, ("two", 0): False, ("over", 0): True, ("over", 1): False}


def test_resume_needs_exactly_the_recorded_shards(spark):
    schema = "unit string, shard int"
    recorded = spark.createDataFrame([("a", 0), ("b", 0), ("c", 0)], schema)
    stored = spark.createDataFrame([("a", 0), ("b", 0), ("b", 1), ("d", 0)], schema)
    units = spark.createDataFrame([(u, 0) for u in "abcde"], schema)
    assert {r["unit"] for r in shards.complete_units(recorded, stored, units).filter("complete").collect()} == {"a"}


def test_nodes_and_deletion(spark):
    paths = spark.createDataFrame([("A/1/0",), ("A/1/1",), ("A/10/0",), ("B/1/0",)], "path string")
    nodes = H.nodes(paths)
    assert nodes.count() == 2 + 3 + 4 and H.leaves(nodes).count() == 4
    assert {r["path"] for r in H.delete(nodes, "A/1").filter("depth > 1").collect()} == {"A/10", "A/10/0", "B/1", "B/1/0"}
    assert H.lookup(nodes, "/A/10/").count() == 1


def test_renaming_wells(spark):
    wells = spark.createDataFrame([("B/03",), ("C/1",)], "path string")
    mapping = spark.createDataFrame([("B/03", "D/4")], "old string, new string")
    assert {tuple(r) for r in H.rename_wells(wells, mapping).collect()} == {("B/03", "D/4"), ("C/1", "C/1")}
    with pytest.raises(Exception, match="two wells"):
        H.rename_wells(wells, spark.createDataFrame([("B/03", "C/1")], "old string, new string")).collect()


def test_archives(spark):
    rows = [("z/c", 0), ("b/zarr.json", 1), ("zarr.json", 2), ("z/c", 3), ("../x", 4), ("d/", 5), ("a/zarr.json", 6)]
    entries = spark.createDataFrame([(0, n, o) for n, o in rows], "archive int, name string, ordinal long")
    order = archives.pack_order(entries, ["archive"]).orderBy("position").collect()
    assert [r["name"] for r in order][:4] == ["zarr.json", "a/zarr.json", "b/zarr.json", "z/c"]
    safe = entries.filter("ordinal <> 4")
    assert {(r["name"], r["ordinal"]) for r in archives.unpack(safe, ["archive"]).collect()} == {("z/c", 3), ("b/zarr.json", 1), ("zarr.json", 2), ("a/zarr.json", 6)}
    for bad in ("../x", "/x", "a/../../x", "C:/x", "a\\..\\x"):
        with pytest.raises(Exception, match="unsafe name"):
            archives.unpack(entries.withColumn("name", F.when(F.col("ordinal") == 4, bad).otherwise(F.col("name"))), ["archive"]).collect()
    assert tuple(archives.summary(entries, ["archive"]).first())[1:] == (7, 3, 1)
    said = '{"ome": {"version": "0.5", "zipFile": {"centralDirectory": {"jsonFirst": true}}}}'
    assert tuple(one(spark, archives.comment_fields(F.lit(said)))[0]) == ("0.5", True)
    for other in ("", "{}", "not json", None):
        got = one(spark, archives.comment_fields(F.lit(other).cast("string")))[0]
        assert got is None or tuple(got) == (None, None)


def test_acquisition_files(spark, tmp_path):
    for c, n in (("C0L0", 4), ("C1L0", 3)):
        (tmp_path / f"{c}.index.txt").write_text("".join(f"{t}\t{t * 45.0:.4f}\t64, 32, {n}\n" for t in range(2)))
        lines = [f'{{"Channel": "{c}", "TimeStampInNanoSeconds": {t * 45_000_000}, "AcquisitionType": "NA", "VoxelDimX": 0.25, "VoxelDimY": 0.25, "VoxelDimZ": 1.0}}' for t in range(3)]
        (tmp_path / f"{c}.metadata.txt").write_text("\n".join([*lines, "{broken"]) + "\n")
    assert tuple(acquisitions.shape(acquisitions.index_lines(spark, str(tmp_path))).first()) == (2, 2, 3, 32, 64)
    got = acquisitions.summary(acquisitions.metadata_lines(spark, str(tmp_path))).first()
    assert (got["voxel_size_z"], got["voxel_size_y"], got["time_delta_ms"], got["acquisition_type"]) == (1.0, 0.25, 45.0, "NA")


def summary_json(version, **more):
    import json

    return json.dumps({"Summary": {"MicroManagerVersion": version, "Height": 8, "Width": 4} | more})


def test_acquisition_summaries(spark):
    later = {"Label": "A1", "GridRow": 0, "DevicePositions": [{"Device": "XY", "Position_um": [1.0, 0.0]}, {"Device": "Z", "Position_um": [3.5]}]}
    beta = {"label": "p0", "gridRow": 1, "gridCol": 2, "subpositions": [{"stageName": "XY", "x": 1.5, "y": 2.5, "z": 0}, {"stageName": "Z", "x": 9, "y": 0, "z": 0}]}
    rows = [
        (0, summary_json("2.0.1", ChNames=["a", "b"], Positions=2, StagePositions=[later, later | {"Label": "A2"}], **{"z-step_um": 0.25, "Interval_ms": 500})),
        (1, summary_json("2.0.0-beta3", Channels=2, Positions=2, StagePositions=[beta, beta], **{"z-step_um": 0.0})),
        (2, summary_json("1.4.22", Positions=1, StagePositions=[later])),
        (3, None),
        (4, "{broken"),
    ]
    df = spark.createDataFrame(rows, "k int, text string")
    got = {r["k"]: tuple(r)[1:] for r in acquisitions.acquisition_summary(df, ["k"], "text").collect()}
    assert got[0] == ("2.0.1", ["a", "b"], 8, 4, 0.25, 0.5)
    assert got[1] == ("2.0.0-beta3", ["", ""], 8, 4, 1.0, 1.0)
    assert got[2] == ("1.4.22", [], 8, 4, 1.0, 1.0) and got[3][0] is None and got[4][0] is None
    stages = {tuple(r)[:4]: r["values"] for r in acquisitions.stage_positions(df, ["k"], "text").collect()}
    assert stages == {
        (0, 0, "A1", "XY"): [1.0, 0.0],
        (0, 0, "A1", "Z"): [3.5],
        (0, 1, "A2", "XY"): [1.0, 0.0],
        (0, 1, "A2", "Z"): [3.5],
        (1, 0, "p0", "XY"): [1.5, 2.5],
        (1, 0, "p0", "Z"): [9.0],
        (1, 1, "p0", "XY"): [1.5, 2.5],
        (1, 1, "p0", "Z"): [9.0],
    }
    saved = df.filter("k = 0").withColumn("sites", F.array(F.lit(1)))
    assert {(r["position"], r["label"]) for r in acquisitions.stage_positions(saved, ["k"], "text", "sites").collect()} == {(0, "A2")}


def test_channels(spark):
    from voxelframe.operators import images as I

    window = F.struct(F.lit(0.0).alias("start"), F.lit(5.0).alias("end"), F.lit(0.0).alias("min"), F.lit(9.0).alias("max"))
    channels = spark.createDataFrame([(0, "BF", 0), (0, "GFP", 1), (1, "BF", 0)], "image int, name string, index long").withColumn("window", window)
    out = {(r["image"], r["name"]): tuple(r["window"]) for r in I.set_window(channels, 0, "GFP", 1.0, 2.0).collect()}
    assert out == {(0, "BF"): (0.0, 5.0, 0.0, 9.0), (0, "GFP"): (1.0, 2.0, 0.0, 9.0), (1, "BF"): (0.0, 5.0, 0.0, 9.0)}
    assert {(r["image"], r["name"]) for r in I.rename_channel(channels, "BF", "Phase").collect()} == {(0, "Phase"), (0, "GFP"), (1, "Phase")}
    with pytest.raises(Exception, match="already"):
        I.rename_channel(channels, "BF", "GFP").collect()
    asked = spark.createDataFrame([(0, "GFP")], "image int, name string")
    assert I.channel_index(channels, asked).first()["index"] == 1
    with pytest.raises(Exception, match="no such channel"):
        I.channel_index(channels, asked.withColumn("name", F.lit("x"))).collect()
    attributes = spark.createDataFrame([(0, "a", "1")], "image int, key string, value string")
    with pytest.raises(Exception, match="reserved key"):
        I.merge_attributes(attributes, attributes.withColumn("key", F.lit("omero"))).collect()


def test_sites_are_paired_by_their_order(spark):
    from voxelframe.operators import images as I

    a = spark.createDataFrame([(k * k + 3, f"p{k}") for k in range(50)], "k long, position string")
    b = spark.createDataFrame([(-7 * k, f"f{k}") for k in range(49, -1, -1)], "j long, field string")
    out = {r["position"]: r["field"] for r in I.pair_sites(a, b, ["k"], ["j"]).collect()}
    assert out == {f"p{k}": f"f{49 - k}" for k in range(50)}
    for few, many in ((a.limit(49), b), (a, b.limit(3))):
        with pytest.raises(Exception, match="no partner"):
            I.pair_sites(few, many, ["k"], ["j"]).collect()
    assert I.pair_sites(a.limit(0), b.limit(0), ["k"], ["j"]).collect() == []


def test_ordinals_of_many_rows(spark):
    rows = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("k"), (F.col("id") % 7).alias("other"))
    got = windows.ordinals(rows.repartition(7), ["k"]).orderBy("k").select("ordinal").collect()
    assert [r[0] for r in got] == list(range(20_000))


def test_broken_lines_are_set_apart(spark):
    from voxelframe.operators import images as I

    lines = [(0, '{"a":1,"b":"x"}'), (1, '{"a":1,"b":'), (2, '{"a":"no"}'), (3, ""), (4, None), (5, "{}"), (6, '[1]'), (7, '{"a":null,"c":[1]}'), (0, '{"a":1,"b":"x"}')]
    fine, broken = I.parted(spark.createDataFrame(lines, "k int, line string"), "line", "a long, b string")
    assert sorted((r["k"], r["metadata"]["a"], r["metadata"]["b"]) for r in fine.collect()) == [(0, 1, "x"), (0, 1, "x"), (5, None, None), (7, None, None)]
    assert sorted((r["k"], r["line"]) for r in broken.collect() if r["line"] is not None) == [(1, '{"a":1,"b":'), (2, '{"a":"no"}'), (3, ""), (6, "[1]")]
    assert fine.count() + broken.count() == len(lines)


def test_chunks_asked_for_by_sizes(spark):
    def ask(sizes, shape, item=2, most=500_000_000):
        return one(spark, shapes.chosen_chunk(longs(*sizes), longs(*shape), F.lit(item), most))[0]

    got = ask((1, 1, 8, 600, 100), (5, 2, 4, 512, 512))
    assert (got["chunk"], got["clamped"]) == ([1, 1, 4, 512, 100], [2, 3])
    got = ask((1, 1, 1187, 256, 256), (1, 1, 1187, 256, 256), most=40_000_000)
    assert got["chunk"] == [1, 1, 297, 256, 256] and got["clamped"] == [2]
    with pytest.raises(Exception, match="five sizes"):
        ask((1, 8, 8), (1, 1, 8, 8, 8))


def test_halving_in_one_step_is_halving_in_a_loop(spark):
    def looped(z, plane, most):
        while z > 1 and z * plane > most:
            z = -(-z // 2)
        return z

    import random

    rng = random.Random(3)
    rows = [(rng.randrange(1, 5000), rng.randrange(300), m) for m in (1, 7, 1000, 500_000_000) for _ in range(200)]
    rows += [(z, p, 500_000_000) for z in (1, 2, 3, 1187, 1 << 40) for p in (1, 62_500_000, 499_999_999, 500_000_000, 500_000_001)]
    for most in {m for _, _, m in rows}:
        own = [(z, p) for z, p, m in rows if m == most]
        shape = F.array(F.lit(1).cast("long"), F.lit(1).cast("long"), "z", F.lit(1).cast("long"), "p")
        df = spark.createDataFrame(own, "z long, p long").select("z", "p", shapes.limited_chunk(shape, F.lit(1), most)[2].alias("a"), shapes.chosen_chunk(shape, shape, F.lit(1), most)["chunk"][2].alias("b"))
        assert [(r["a"], r["b"]) for r in df.collect()] == [(looped(r["z"], r["p"], most),) * 2 for r in df.collect()]


def test_chunk_sizes_are_said_without_loops_over_their_digits(spark):
    """A loop over an array inside each row's expression took half a millisecond a row."""
    sizes = F.array("id", "id", "id", "id", "id")
    df = spark.range(10).select(shapes.chosen_chunk(sizes, sizes, F.lit(4)).alias("g"), shapes.limited_chunk(sizes, F.lit(4)).alias("v"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and "transform(" not in plan
    short, none = longs(1, 1, 8), F.lit(None).cast("array<bigint>")
    got = one(spark, shapes.chosen_chunk(longs(1, 2, 9, 4, 5), short, F.lit(1)))[0]
    assert (got["chunk"], got["clamped"]) == ([1, 1, 8, 4, 5], [1, 2])
    assert one(spark, shapes.chosen_chunk(longs(1, 2, 9, 4, 5), longs(1, 2, 9, 4, 5, 6), F.lit(1)))[0]["chunk"] == [1, 2, 9, 4, 5, 6]
    assert one(spark, shapes.chosen_chunk(longs(1, 2, 9, 4, 5), none, F.lit(1)))[0]["chunk"] is None


def test_sizes_up_to_a_unit(spark):
    from voxelframe.operators import images as I

    assert [one(spark, names.size_text(F.lit(n), "KiB"))[0] for n in (1023, 1024, 980 * 256, 5681 * 256, 1 << 40)] == ["1023 B", "1.0 KiB", "245.0 KiB", "1420.2 KiB", "1073741824.0 KiB"]
    levels = spark.createDataFrame([(1, 0, [5681, 64], "float32", 4)], "image int, level int, shape array<long>, dtype string, item int")
    assert I.report(levels, "KiB").first()["report"] == "5681x64 float32 1420.2 KiB"
    assert I.report(levels).first()["report"] == "5681x64 float32 1.4 MiB"


def test_axes_by_name_and_indices_by_request(spark):
    axes = F.array(*[F.lit(a) for a in "TCZYX"])
    assert [one(spark, shapes.axis_index(axes, F.lit(a)))[0] for a in ("t", "Z", "x")] == [0, 2, 4]
    with pytest.raises(Exception, match="no such axis"):
        one(spark, shapes.axis_index(axes, F.lit("q")))
    none, no_list = F.lit(None).cast("long"), F.lit(None).cast("array<long>")
    assert one(spark, shapes.as_indices(F.lit(3), no_list, none, none))[0] == [3]
    assert one(spark, shapes.as_indices(none, longs(5, 0, 5), none, none))[0] == [5, 0, 5]
    assert one(spark, shapes.as_indices(none, no_list, F.lit(2), F.lit(7), 2))[0] == [2, 4, 6]
    fits = lambda a, b: not one(spark, shapes.shape_mismatch(longs(*a), longs(*b)))[0]
    assert fits((1, 2), (1, 2)) and not fits((1, 2), (1, 3)) and not fits((1, 2), (1, 2, 1))


@pytest.mark.parametrize("n", [2, 3, 4, 5])
def test_axes_are_written_and_read_with_the_table(spark, tmp_path, n):
    from voxelframe.operators import coords

    names_ = "tczyx"[-n:]
    about = {a: {"kind": "channel"} if a == "c" else {"kind": "time", "unit": "second", "scale": 2.5} if a == "t" else {"unit": "micrometer", "scale": 0.25 * (k + 1), "translation": -1.5} for k, a in enumerate(names_)}
    extra = {"by": "me", "nested": {"k": [1, 2.5, None, "é"]}}
    cells = spark.createDataFrame([(*([k] * n), k * 10) for k in range(3)], ", ".join(f"{a} long" for a in names_) + ", value long")
    coords.with_axes(cells, about, extra).write.parquet(str(tmp_path / "a"))
    back = spark.read.parquet(str(tmp_path / "a"))
    axes, attributes = coords.axes_of(back)
    assert attributes == extra and list(axes) == list(names_)
    for a in names_:
        want = {"unit": None, "scale": 1.0, "translation": 0.0, "kind": "space"} | about[a]
        assert axes[a] == want
    row = coords.labelled(back.filter(F.col("x") == 2)).first()
    assert all(row[f"{a}_coord"] == 2 * axes[a]["scale"] + axes[a]["translation"] for a in names_)
    assert coords.axes_of(back.filter("x > 0").select("x", "value"))[0] == {"x": axes["x"]}
    with pytest.raises(ValueError, match="no unit"):
        coords.with_axes(cells, {"x": {"unit": "second"}})
    assert coords.axes_of(cells) == ({}, {})


def test_create_or_append(spark):
    there = spark.createDataFrame([("w", "a", 0), ("w", "b", 1)], "well string, name string, index long")
    wanted = spark.createDataFrame([("w", "b"), ("w", "d"), ("w", "c"), ("w", "c"), ("v", "x")], "well string, name string")
    assert {tuple(r) for r in H.create_or_append(there, wanted, ["well"], "name").collect()} == {("w", "a", 0), ("w", "b", 1), ("w", "c", 2), ("w", "d", 3), ("v", "x", 0)}


def test_trees(spark):
    nodes = H.nodes(spark.createDataFrame([("A/10/0",), ("A/2/0",)], "path string"))
    assert [r["path"] for r in H.tree(nodes, 2).orderBy("order").collect()] == ["A", "A/2", "A/10"]


def test_readers(spark):
    from voxelframe.sources import formats

    pick = lambda path, kind=None, index=False: one(spark, formats.reader(F.lit(path), F.lit(index), F.lit(kind).cast("string")))[0]
    assert (pick("a.nd2"), pick("b/c.zarr"), pick("d", index=True), pick("e", "ndtiff"), pick("f.ozx", "archive")) == ("nd2", "zarr", "ndtiff", "ndtiff", "archive")
    for path, kind in (("x.doc", None), ("a.nd2", "zarr")):
        with pytest.raises(Exception, match="no reader|isn't"):
            pick(path, kind)


def test_formats_are_told_by_what_lies_in_a_path(spark, tmp_path):
    from voxelframe.sources import formats

    files = {
        "store": ["zarr.json", "0/zarr.json"], "old": [".zgroup"], "named.zarr": ["x"], "nd": ["NDTiff.index", "a.tif"], "below": ["sub/NDTiff.index"],
        "cc": ["C0.index.txt", "C0.metadata.txt"], "ome": ["s/a.OME.TIF", "s/b.tif"], "tif": ["b.tiff"], "none": ["notes.md"], "deep": ["a/zarr.json"],
    }
    for folder, own in files.items():
        for name in own:
            (tmp_path / folder / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / folder / name).write_text("x")
    for one_file in ("a.nd2", "b.ozx", "c.ome.tiff", "d.tif", "e.doc"):
        (tmp_path / one_file).write_text("x")
    roots = [*files, "a.nd2", "b.ozx", "c.ome.tiff", "d.tif", "e.doc"]
    listed = formats.listing(spark, *(str(tmp_path / r) for r in roots), f"file://{tmp_path}/store")
    got = {r["root"]: r["format"] for r in formats.infer_from_files(listed).collect()}
    want = ["zarr", "zarr", "zarr", "ndtiff", None, "clearcontrol", "ome-tiff", "single-page-tiff", None, None, "nd2", "archive", "ome-tiff", "single-page-tiff", None]
    assert [got[str(tmp_path / r)] for r in roots] == want and got[f"file://{tmp_path}/store"] == "zarr"
    assert listed.filter("bytes != 1").count() == 0


def test_metadata_of_plates_and_wells(spark):
    import json

    rows = [("B", "10", "0"), ("A", "2", "10"), ("A", "2", "9"), ("A", "10", "0"), ("A", "2", "9")]
    positions = spark.createDataFrame(rows, "row string, column string, field string")
    wells = {(r["row"], r["column"]): json.loads(r["meta"]) for r in H.well_metadata(positions).collect()}
    assert wells["A", "2"] == {"ome": {"version": "0.5", "well": {"images": [{"path": "9"}, {"path": "10"}]}}} and len(wells) == 3
    assert json.loads(H.well_metadata(positions, "0.4").filter("row = 'B'").first()["meta"]) == {"well": {"images": [{"path": "0"}], "version": "0.4"}}
    plate = json.loads(H.plate_metadata(positions.withColumn("p", F.lit(1)), ["p"], field_count=True).first()["meta"])["ome"]
    assert plate["plate"]["rows"] == [{"name": "A"}, {"name": "B"}] and plate["plate"]["columns"] == [{"name": "2"}, {"name": "10"}]
    assert plate["plate"]["wells"] == [{"path": "A/2", "rowIndex": 0, "columnIndex": 0}, {"path": "A/10", "rowIndex": 0, "columnIndex": 1}, {"path": "B/10", "rowIndex": 1, "columnIndex": 1}]
    assert plate["plate"]["field_count"] == 2 and plate["version"] == "0.5"
    assert "field_count" not in H.plate_metadata(positions.withColumn("p", F.lit(1)), ["p"]).first()["meta"]
