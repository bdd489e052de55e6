"""The reader of stores' metadata files, and versions found below the root."""

import json
import os

import pytest
from pyspark.sql import functions as F

from voxelframe.sources import stores as S

ROWS, COLUMNS, FIELDS, LEVELS = "AB", "123", "0123", "012"


def put(folder, name, meta):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write(meta if isinstance(meta, str) else json.dumps(meta))


def group(**attributes):
    return {"zarr_format": 3, "node_type": "group", "attributes": attributes}


@pytest.fixture(scope="module")
def plate(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("p") / "plate.zarr")
    put(root, "zarr.json", group(ome={"version": "0.5", "plate": {"rows": [{"name": r} for r in ROWS]}}))
    for r in ROWS:
        put(f"{root}/{r}", "zarr.json", group())
        for c in COLUMNS:
            put(f"{root}/{r}/{c}", "zarr.json", group(ome={"version": "0.5", "well": {"images": [{"path": f} for f in FIELDS]}}))
            for f in FIELDS:
                put(f"{root}/{r}/{c}/{f}", "zarr.json", group(ome={"version": "0.5", "multiscales": [{"axes": []}]}))
                for k in LEVELS:
                    put(f"{root}/{r}/{c}/{f}/{k}", "zarr.json", {"zarr_format": 3, "node_type": "array", "shape": [1]})
                    put(f"{root}/{r}/{c}/{f}/{k}/c/0", "0", "no metadata")
    return root


def test_every_node_of_a_plate_is_read(spark, plate):
    for split in (0, 1, 2, 9):
        rows = S.nodes(spark, plate, split=split).collect()
        wells = [f"{r}/{c}" for r in ROWS for c in COLUMNS]
        want = ["", *ROWS, *wells, *(f"{w}/{f}" for w in wells for f in FIELDS), *(f"{w}/{f}/{k}" for w in wells for f in FIELDS for k in LEVELS)]
        assert sorted(r["path"] for r in rows) == sorted(want)
        assert all(r["depth"] == (r["path"].count("/") + 1 if r["path"] else 0) and r["format"] == 3 and r["problem"] is None for r in rows)
        assert {r["kind"] for r in rows if r["depth"] == 4} == {"array"} and {r["kind"] for r in rows if r["depth"] < 4} == {"group"}
    assert S.nodes(spark, plate, split=1).rdd.getNumPartitions() == 3


def walked(plate, **how):
    reader = S.MetadataReader(plate, **how)
    looked = []
    real = reader._node
    reader._node = lambda files, root, path: looked.append(path) or real(files, root, path)
    return {r[0] for p in reader.partitions() for r in reader.read(p)}, looked


def test_options_cut_the_walk(spark, plate):
    whole, looked_whole = walked(plate)
    rows, looked = walked(plate, deepest=1)
    assert rows == {"", "A", "B"} and len(looked) < 10
    rows, looked = walked(plate, under="/B/2/")
    assert rows == {p for p in whole if p == "B/2" or p.startswith("B/2/")} and not any(p.startswith("A/") for p in looked) and len(looked) < len(looked_whole) / 3
    assert walked(plate, under="B/7")[0] == set() and walked(plate, under="A/1/0", deepest=3)[0] == {"A/1/0"}
    assert S.nodes(spark, plate, under="A/1", deepest=3).count() == 5


def test_nodes_meet_themselves(spark, plate):
    nodes = S.nodes(spark, plate)
    wells = nodes.filter("depth = 2").select(F.col("path").alias("well"))
    pairs = nodes.filter("depth = 3").join(wells, F.regexp_replace("path", "/[^/]*$", "") == F.col("well"))
    assert pairs.count() == 24 and nodes.count() == 105
    assert nodes.filter("path = 'A'").crossJoin(nodes.filter("path like 'B/_'").select("depth")).count() == 3
    first = nodes.filter("depth = 2").select(F.get_json_object("attributes", "$.ome.well.images[0].path").alias("p"))
    assert {r["p"] for r in first.collect()} == {"0"}


def test_layout_and_version(spark, plate, tmp_path):
    layout, version, nodes = S.open_store(spark, plate)
    assert (layout, version) == ("hcs", "0.5") and nodes.count() == 105
    assert S.open_store(spark, f"{plate}/A/1/0")[0] == "fov" and S.open_store(spark, f"{plate}/A/1/0", "tiled")[0] == "tiled"
    with pytest.raises(ValueError, match="isn't that"):
        S.open_store(spark, plate, "fov")
    with pytest.raises(ValueError, match="unknown"):
        S.open_store(spark, plate, "x")
    with pytest.raises(KeyError):
        S.open_store(spark, f"{plate}/A")
    with pytest.raises(FileNotFoundError):
        S.open_store(spark, str(tmp_path / "none"))
    old = str(tmp_path / "old.zarr")
    put(old, ".zgroup", {"zarr_format": 2})
    put(old, ".zattrs", {"multiscales": [{"version": "0.4"}]})
    put(f"{old}/0", ".zarray", {"zarr_format": 2, "shape": [2]})
    put(f"{old}/broken", ".zgroup", "{")
    layout, version, nodes = S.open_store(spark, old)
    got = {r["path"]: (r["kind"], r["format"], r["problem"] is None) for r in nodes.collect()}
    assert (layout, version) == ("fov", "0.4") and got == {"": ("group", 2, True), "0": ("array", 2, True), "broken": (None, None, False)}
    put(str(tmp_path / "bad"), "zarr.json", "no json")
    with pytest.raises(FileNotFoundError, match="bad"):
        S.open_store(spark, str(tmp_path / "bad"))


def test_versions_are_found_below_the_root(spark):
    series = '{"bioformats2raw.layout":3}'
    cases = {
        "own": ([("", 3, '{"ome":{"version":"0.5"}}'), ("0", 3, '{"ome":{"version":"0.6"}}')], "0.5"),
        "flat": ([("", 2, '{"multiscales":[{},{"version":"0.4"}]}')], "0.4"),
        "plate": ([("", 2, '{"plate":{"version":"0.3"},"ome":{"version":"0.9"}}')], "0.3"),
        "series": ([("", 2, series), ("OME", 2, '{"ome":{"version":"9"}}'), ("10", 2, '{"multiscales":[{"version":"0.2"}]}'), ("2", 2, '{"multiscales":[{"version":"0.1"}]}'), ("0", 2, "{}")], "0.1"),
        "wrapped": ([("", 3, '{"ome":{"bioformats2raw.layout":3}}'), ("0", 3, "{}")], "0.5"),
        "bare": ([("", 2, series)], "0.4"),
        "well": ([("", 3, "{}"), ("A", 3, '{"ome":{"version":"7"}}'), ("B/1", 3, '{"well":{"version":"0.8"}}'), ("A/10", 3, '{"well":{"version":"0.7"}}'), ("A/2", 3, '{"well":{"version":""}}')], "0.7"),
        "none": ([("", 3, "{}"), ("A", 3, "{}"), ("A/1", 3, "{}"), ("A/1/0", 3, '{"ome":{"version":"0.5"}}')], "unknown"),
        "unread": ([("", None, None), ("A/1", 3, '{"well":{"version":"0.5"}}')], None),
    }
    rows = [(k, p, p.count("/") + 1 if p else 0, f, a) for k, (nodes, _) in cases.items() for p, f, a in nodes]
    got = S.versions(spark.createDataFrame(rows, "store string, path string, depth int, format int, attributes string").repartition(5), ["store"])
    assert {r["store"]: r["version"] for r in got.collect()} == {k: want for k, (_, want) in cases.items()}


def test_layouts_of_no_kind_raise(spark):
    pick = lambda a: spark.range(1).select(S.layout_of(F.lit(a))).first()[0]
    assert pick('{"ome":{"plate":{}}}') == "hcs" and pick('{"multiscales":[]}') == "fov"
    with pytest.raises(Exception, match="no known layout"):
        pick('{"notes":1}')


def test_images_are_read_by_what_lies_there(spark, plate, tmp_path):
    from voxelframe.sources import formats

    kind, tables = formats.read_images(spark, plate)
    assert kind == "zarr" and tables["nodes"].count() == 105
    (tmp_path / "cc").mkdir()
    (tmp_path / "cc" / "C0.index.txt").write_text("0\t0.5\t4, 3, 2\n1\t0.6\t4, 3, 2\n")
    (tmp_path / "cc" / "C0.metadata.txt").write_text('{"Channel":"C0","TimeStampInNanoSeconds":1}\n')
    kind, tables = formats.read_images(spark, str(tmp_path / "cc"))
    assert kind == "clearcontrol" and tuple(tables["shape"].first()) == (2, 1, 2, 3, 4) and tables["metadata"].count() == 1
    (tmp_path / "a.nd2").write_text("x")
    with pytest.raises(NotImplementedError, match="nd2"):
        formats.read_images(spark, str(tmp_path / "a.nd2"))
    (tmp_path / "b.doc").write_text("x")
    with pytest.raises(ValueError, match="no reader"):
        formats.read_images(spark, str(tmp_path / "b.doc"))
