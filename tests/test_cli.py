import numpy as np
import pytest

from voxelframe import cli
from voxelframe.operators import cells as C
from voxelframe.sources import arrays


def test_store_commands(spark, tmp_path, capsys):
    a = np.random.default_rng(0).integers(0, 9, (10, 6))
    spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(a)], "vec_id long, embedding array<long>").write.parquet(str(tmp_path / "in"))
    store = str(tmp_path / "store")
    cli.main(["convert", str(tmp_path / "in"), store, "--chunk", "4,4"], spark)
    cli.main(["compute-pyramid", store, "--levels", "2", "--method", "max"], spark)
    meta = cli.read_meta(spark, store)
    assert meta["levels"] == [{"y": 10, "x": 6}, {"y": 5, "x": 3}]
    got = C.dense(arrays.read(spark, f"{store}/level=1", meta["chunk"]), meta["levels"][1])
    assert (got == a.reshape(5, 2, 3, 2).max(axis=(1, 3))).all()
    cli.main(["set-scale", store, "--axis", "x", "--value", "0.5"], spark)
    cli.main(["info", store], spark)
    assert "2 level(s)" in capsys.readouterr().out and cli.read_meta(spark, store)["history"] == [{"y": 1.0, "x": 1.0}]
    with pytest.raises(ValueError):
        cli.main(["set-scale", store, "--axis", "q", "--value", "1"], spark)
    with pytest.raises(ValueError):
        cli.main(["compute-pyramid", store, "--dims", "t"], spark)


def test_rename_wells(spark, tmp_path):
    spark.createDataFrame([("B/03",), ("C/1",)], "path string").write.parquet(str(tmp_path / "wells"))
    (tmp_path / "map.csv").write_text("B/03,D/4\n")
    cli.main(["rename-wells", str(tmp_path / "wells"), str(tmp_path / "map.csv"), str(tmp_path / "out")], spark)
    assert {r["path"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"D/4", "C/1"}


def test_plates_are_expanded_to_their_positions(spark, tmp_path):
    from voxelframe import cli

    plate = tmp_path / "plate.zarr"
    for p in ("A/10/0", "A/2/0", "B/1/1", "B/1/0"):
        (plate / p).mkdir(parents=True)
        (plate / p / "image.json").write_text("{}")
    names = [p.split("plate.zarr/")[1] for p in cli.expand(spark, [str(plate)])]
    assert names == ["A/2/0", "A/10/0", "B/1/0", "B/1/1"]
    one = str(plate / "B/1/0")
    assert cli.expand(spark, [one, one + "/"]) == [one, one]
    with pytest.raises(FileNotFoundError):
        cli.expand(spark, [str(tmp_path / "none")])
