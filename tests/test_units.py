"""Units that write and resume, with runs that die between writing and completing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelframe.operators import cells as C
from voxelframe.operators import units as U
from voxelframe.sources import arrays as A

SIZES = {"t": 5, "c": 2, "z": 1, "y": 3, "x": 4}
CHUNK = {"t": 2, "c": 2, "z": 1, "y": 2, "x": 3}


@pytest.fixture(scope="module")
def data():
    a = np.random.default_rng(5).integers(1, 9, (2, *SIZES.values()))
    a[0, 1:3] = 0  # empty times, of which no chunk is held by itself
    a[1, 4, 1] = 0  # an empty channel
    return a


@pytest.fixture(scope="module")
def source(spark, data):
    out = None
    for p in range(2):
        index = np.argwhere(data[p] != 0)
        rows = [(*map(int, i), int(data[p][tuple(i)])) for i in index]
        cells = spark.createDataFrame(rows, ", ".join(f"{a} long" for a in U.AXES) + ", value long")
        own = A.to_chunks(cells, SIZES, CHUNK).withColumn("position", F.lit(f"A/1/{p}"))
        out = own if out is None else out.unionByName(own)
    return out


def scaling():
    def scaled(volume, input_time_index, by=3):
        return volume * by + input_time_index

    return scaled  # of no module, so that workers needn't import this one


scaled = scaling()


def found(spark, store, p, sizes=SIZES, chunk=None):
    chunk = {a: 1 if a in "tc" else (chunk or CHUNK)[a] for a in U.AXES}
    rows = U.read(spark, store).filter(F.col("position") == f"A/1/{p}")
    return C.dense(A.to_cells(rows, chunk), sizes)


def expected(a, by=3, groups=((0,), (1,))):
    out = np.zeros_like(a)
    for t in range(a.shape[0]):
        for g in groups:
            own = a[t, list(g)]
            if not (own.reshape(len(g), -1) == 0).all(axis=1).any():
                out[t, list(g)] = own * by + t
    return out


def test_all_units_are_written(spark, source, data, tmp_path):
    store = str(tmp_path / "s")
    assert U.process(source, store, scaled, CHUNK, SIZES, by=2) == 20
    for p in range(2):
        assert (found(spark, store, p) == expected(data[p], 2)).all()
    assert U.process(source, store, scaled, CHUNK, SIZES, resume=True, by=2) == 0
    # Without resuming all are made again, and what is read is of the last run.
    assert U.process(source, store, scaled, CHUNK, SIZES, by=5) == 20
    assert (found(spark, store, 1) == expected(data[1], 5)).all()


def test_a_run_that_dies_before_it_completes_is_made_again(spark, source, data, tmp_path, monkeypatch):
    store = str(tmp_path / "s")
    real = U._complete

    def lost(*_):
        raise OSError("lost")

    monkeypatch.setattr(U, "_complete", lost)
    with pytest.raises(OSError):
        U.process(source, store, scaled, CHUNK, SIZES)
    # All was written, and nothing counts.
    assert spark.read.parquet(f"{store}/chunks").count() > 0
    assert U.read(spark, store).count() == 0 and U.completed(spark, store).count() == 0
    assert {(r["state"], r["run"]) for r in U.states(spark, store).collect()} == {("in flight", 1)}
    monkeypatch.setattr(U, "_complete", real)
    assert U.process(source, store, scaled, CHUNK, SIZES, resume=True) == 20
    for p in range(2):
        assert (found(spark, store, p) == expected(data[p])).all()
    assert {r["run"] for r in U.read(spark, store).select("run").distinct().collect()} == {2}


def test_waves_that_were_committed_stay(spark, source, data, tmp_path, monkeypatch):
    store = str(tmp_path / "s")
    real, calls = U._mapped, []

    def dies(*given):
        calls.append(1)
        if len(calls) == 3:
            raise OSError("lost")
        return real(*given)

    monkeypatch.setattr(U, "_mapped", dies)
    with pytest.raises(OSError):
        U.process(source, store, scaled, CHUNK, SIZES, wave=5)
    done, begun = U.completed(spark, store).count(), U.states(spark, store).count()
    assert 0 < done < begun < 20
    monkeypatch.setattr(U, "_mapped", real)
    assert U.process(source, store, scaled, CHUNK, SIZES, resume=True, wave=5) == 20 - done
    assert (found(spark, store, 0) == expected(data[0])).all()


def test_lost_shards_and_other_settings_are_made_again(spark, source, data, tmp_path):
    import shutil

    store = str(tmp_path / "s")
    U.process(source, store, scaled, CHUNK, SIZES, wave=10, token="a")
    assert U.process(source, store, scaled, CHUNK, SIZES, resume=True, token="a") == 0
    one = spark.read.parquet(f"{store}/chunks/run=1").filter("shards is not null and size(shards) > 0").select("unit").distinct().count()
    shutil.rmtree(f"{store}/chunks/run=1")
    assert U.process(source, store, scaled, CHUNK, SIZES, resume=True, token="a") == one
    assert U.process(source, store, scaled, CHUNK, SIZES, resume=True, token="b", by=4) == 20
    assert (found(spark, store, 0) == expected(data[0], 4)).all()


def test_indices_groups_shapes_and_types(spark, source, data, tmp_path):
    store = str(tmp_path / "s")
    out = {"t": 9, "c": 4, "z": 1, "y": 3, "x": 2}
    half = lambda volume: volume[..., ::2] / 2
    n = U.process(source, store, half, CHUNK, SIZES, times=[(0, 8), (3, 1)], channels=[([0, 1], [3, 0])], out_sizes=out, to={"z": 1, "y": 1, "x": 2}, kind="double")
    assert n == 4
    got = found(spark, store, 1, out, {"z": 1, "y": 1, "x": 2})
    want = np.zeros(tuple(out.values()))
    for i, o in ((0, 8), (3, 1)):
        want[o, [3, 0]] = data[1][i][..., ::2] / 2
    assert (got == want).all()
    for bad in ({"times": [(5, 0)]}, {"channels": [([0], [2])]}, {"times": [(0, 1), (1, 1)]}, {"channels": [([0], [0, 1])]}):
        with pytest.raises(ValueError):
            U.process(source, store, half, CHUNK, SIZES, **bad)
    with pytest.raises(Exception, match="returned"):
        U.process(source, str(tmp_path / "w"), half, CHUNK, SIZES)
    assert U.process(source, store, half, CHUNK, SIZES, times=[]) == 0
