"""Array operators against NumPy, on small random arrays."""

import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxelframe.operators import cells as C
from voxelframe.operators import chunks as K
from voxelframe.operators import coords, pool, volumes
from voxelframe.sources import arrays as A

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frame(spark, a, axes):
    index = np.indices(a.shape).reshape(a.ndim, -1)
    rows = [(*map(int, i), v.item()) for i, v in zip(index.T, a.ravel(), strict=True)]
    kind = "double" if a.dtype.kind == "f" else "long"
    return spark.createDataFrame(rows, ", ".join(f"{x} long" for x in axes) + f", value {kind}")


def padded_blocks(a, fy, fx):
    a = np.pad(a, [(0, -a.shape[0] % fy), (0, -a.shape[1] % fx)], mode="edge")
    return a.reshape(a.shape[0] // fy, fy, a.shape[1] // fx, fx).transpose(0, 2, 1, 3).reshape(a.shape[0] // fy, a.shape[1] // fx, -1)


def smallest_mode(block):
    values, n = np.unique(block, return_counts=True)
    return values[n.argmax()]


EXPECTED = {
    "mean": lambda b: np.trunc(b.mean(-1)).astype(int),
    "median": lambda b: np.trunc(np.median(b, -1)).astype(int),
    "min": lambda b: b.min(-1),
    "max": lambda b: b.max(-1),
    "mode": lambda b: np.apply_along_axis(smallest_mode, -1, b),
}


@FEW
@given(st.integers(1, 9), st.integers(1, 9), st.integers(1, 4), st.integers(1, 4), st.sampled_from(sorted(EXPECTED)), st.integers(0, 99))
def test_pool_is_edge_padded_block_reduction(spark, h, w, fy, fx, method, seed):
    a = np.random.default_rng(seed).integers(-9, 9, (h, w))
    got = pool.pool(frame(spark, a, "yx"), {"y": fy, "x": fx}, {"y": h, "x": w}, method)
    want = EXPECTED[method](padded_blocks(a, fy, fx))
    assert (C.dense(got, {"y": want.shape[0], "x": want.shape[1]}) == want).all()


def test_pool_of_an_odd_ramp(spark):
    a = np.tile(np.arange(21.0), (2, 1))
    out = C.dense(pool.pool(frame(spark, a, "yx"), {"x": 2}, {"y": 2, "x": 21}), {"y": 2, "x": 11})
    assert out.shape == (2, 11) and list(out[0, [0, 1, 10]]) == [0.5, 2.5, 20.0]


def test_pool_keeps_nan(spark):
    a = np.array([[1.0, np.nan, 3.0, 4.0]])
    for method in ("mean", "median", "min", "max"):
        out = C.dense(pool.pool(frame(spark, a, "yx"), {"x": 2}, {"y": 1, "x": 4}, method), {"y": 1, "x": 2})
        assert np.isnan(out[0, 0]) and not np.isnan(out[0, 1])


def test_pool_of_an_unknown_method(spark):
    with pytest.raises(ValueError):
        pool.pool(spark.createDataFrame([], "y long, value long"), {"y": 2}, {"y": 0}, "sum")


def test_pyramid_rounds_at_every_level(spark):
    a = np.random.default_rng(0).integers(0, 50, (7, 5))
    levels = pool.pyramid(frame(spark, a, "yx"), ["y", "x"], {"y": 7, "x": 5}, 3)
    want = a
    for k in range(3):
        assert (C.dense(levels.filter(F.col("level") == k), {"y": want.shape[0], "x": want.shape[1]}) == want).all()
        want = EXPECTED["mean"](padded_blocks(want, 2, 2))


@FEW
@given(st.integers(-8, 8), st.integers(-8, 12), st.integers(1, 3), st.lists(st.integers(-6, 5), min_size=1, max_size=5))
def test_selection_is_numpys(spark, start, stop, step, picks):
    a = np.arange(48).reshape(8, 6)
    got = C.select(frame(spark, a, "yx"), {"y": 8, "x": 6}, y=slice(start, stop, step), x=picks)
    want = a[start:stop:step][:, picks]
    assert got.count() == want.size
    if want.size:
        assert (C.dense(got, {"y": want.shape[0], "x": want.shape[1]}, -1) == want).all()


def test_selection_out_of_range(spark):
    e = frame(spark, np.zeros((2, 2)), "yx")
    for key in (2, -3, [0, 2]):
        with pytest.raises(IndexError):
            C.select(e, {"y": 2, "x": 2}, y=key)
    assert C.select(e, {"y": 2, "x": 2}, y=[]).count() == 0


def test_tiles(spark):
    a = np.arange(54).reshape(6, 9)
    sizes = {"y": 6, "x": 9}
    e = frame(spark, a, "yx")
    assert C.tile_grid(sizes, {"y": 2, "x": 4}) == {"y": 3, "x": 2}
    assert (C.dense(C.read_tile(e, 1, 1, (2, 4), sizes), {"y": 2, "x": 4}) == a[2:4, 4:8]).all()
    new = frame(spark, np.full((2, 4), -1), "yx")
    a2 = a.copy()
    a2[4:6, 0:4] = -1
    assert (C.dense(C.write_tile(e, new, 2, 0, (2, 4), sizes), sizes) == a2).all()
    with pytest.raises(IndexError):
        C.read_tile(e, 3, 0, (2, 4), sizes)


def test_tiles_of_a_stack(spark):
    a = np.arange(1, 109).reshape(2, 6, 9)
    sizes = {"t": 2, "y": 6, "x": 9}
    e = frame(spark, a, "tyx")
    assert (C.dense(C.read_tile(e, 1, 1, (2, 4), sizes, t=-1), {"y": 2, "x": 4}) == a[1, 2:4, 4:8]).all()
    out = a.copy()
    out[1, 4:6, 0:4] = -1
    assert (C.dense(C.write_tile(e, frame(spark, np.full((2, 4), -1), "yx"), 2, 0, (2, 4), sizes, t=1), sizes) == out).all()
    with pytest.raises(IndexError):
        C.write_tile(e, frame(spark, np.full((2, 4), -1), "yx"), 2, 0, (2, 4), sizes, t=2)
    tiles = C.make_tiles(frame(spark, a[0], "yx"), (2, 3))
    cells, size = C.join_tiles(tiles, (3, 3), (2, 3))
    assert size == {"y": 6, "x": 9} and (C.dense(cells, size) == a[0]).all()
    with pytest.raises(Exception, match="outside the grid"):
        C.join_tiles(tiles, (3, 2), (2, 3))[0].collect()


def test_missing_cells_read_as_fill(spark):
    e = spark.createDataFrame([(0, 1, 5), (1, 0, None)], "y long, x long, value long")
    assert C.dense(C.fill_missing(e, {"y": 2, "x": 2}, 7), {"y": 2, "x": 2}).tolist() == [[7, 5], [7, 7]]
    assert C.fill_missing(e.limit(0), {"y": 0, "x": 2}).count() == 0


def test_resize_and_append(spark):
    a = np.arange(6).reshape(2, 3)
    e = frame(spark, a, "yx")
    assert (C.dense(C.resize(e, {"y": 2, "x": 3}, {"y": 3, "x": 2}), {"y": 3, "x": 2}) == np.array([[0, 1], [3, 4], [0, 0]])).all()
    assert (C.dense(C.append(e, e, "y", 2), {"y": 4, "x": 3}) == np.vstack([a, a])).all()


def test_blocks_with_an_empty_channel_are_dropped(spark):
    rows = [(0, 0, 0.0), (0, 1, 3.0), (1, 0, 1.0), (1, 1, float("nan")), (2, 0, 0.0), (2, 0, float("nan")), (2, 1, 1.0)]
    kept = C.drop_empty(spark.createDataFrame(rows, "t long, c long, value double"), ["t"], "c")
    assert {r["t"] for r in kept.collect()} == {2}  # a mixture of zero and NaN isn't empty


def test_user_functions_get_their_time(spark):
    a = np.arange(12).reshape(3, 2, 2)
    out = volumes.apply_to_volumes(frame(spark, a, "tyx"), lambda v, input_time_index: v * 10 + input_time_index, ["t"], {"y": 2, "x": 2})
    assert (C.dense(out, {"t": 3, "y": 2, "x": 2}) == a * 10 + np.arange(3)[:, None, None]).all()


def test_rows_are_cut_in_steps_of_bounded_size(spark, monkeypatch):
    import pyarrow as pa

    made = []
    df = spark.range(3000).selectExpr("id AS k", "array_repeat(id + 1, 64) AS v")
    plain = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: (made.append(f), plain(self, f, schema))[1])
    chunk, sizes = {"y": 100, "x": 24}, {"y": 3000, "x": 64}
    rows = K.from_rows(df, "k", "v", lambda v: v, chunk, sizes)
    assert rows.selectExpr("sum(aggregate(values, 0L, (a, n) -> a + n)) AS s").first()["s"] == 64 * 3000 * 3001 // 2
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000), pa.int64()), pa.array([[k + 1] * 64 for k in range(3000)], pa.list_(pa.int64()))], ["row", "values"])
    parts = list(made[0](iter([batch])))
    cells = [len(p.column("values").flatten()) for p in parts]
    assert sum(cells) == 3000 * 64 and max(cells) <= K.STEP_CELLS
    assert sum(sum(p.column("values").flatten().to_pylist()) for p in parts) == 64 * 3000 * 3001 // 2


def test_sparse_volumes_add_no_cells(spark):
    rows = [(0, 0, 0, 5), (0, 1, 1, None), (1, 0, 1, 7)]
    cells = spark.createDataFrame(rows, "t long, y long, x long, value long")
    got = volumes.apply_to_volumes(cells, lambda v, input_time_index: v + 1 + input_time_index, ["t"], {"y": 2, "x": 2}, sparse=True).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(0, 0, 0, 6), (0, 1, 1, None), (1, 0, 1, 9)], key=repr)
    assert volumes.apply_to_volumes(cells, lambda v: v + 1, ["t"], {"y": 2, "x": 2}).count() == 8
    with pytest.raises(Exception, match="sparse volume"):
        volumes.apply_to_volumes(cells, lambda v: v[:1], ["t"], {"y": 2, "x": 2}, sparse=True).collect()


def test_user_map_on_a_last_block_that_is_not_full(spark, tmp_path):
    from voxelframe import plans

    spark.range(53).selectExpr("id AS vec_id", "array(id / 1000D, -id / 1000D) AS embedding").filter("id <> 7").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["block"] * 50 + r["y"], r["x"]): r["value"] for r in plans.QUERIES["user_map"](spark, str(tmp_path)).collect()}
    assert got == {(y, x): (-y if x else y) * 3 + y // 50 for y in range(53) if y != 7 for x in (0, 1)}


@FEW
@given(st.integers(1, 7), st.integers(1, 7), st.integers(1, 4), st.integers(1, 4))
def test_chunks_hold_the_same_cells(spark, h, w, cy, cx):
    a = np.random.default_rng(h * 10 + w).integers(0, 3, (h, w))
    sizes, chunk = {"y": h, "x": w}, {"y": cy, "x": cx}
    back = A.to_cells(A.to_chunks(frame(spark, a, "yx"), sizes, chunk), chunk)
    assert (C.dense(back, sizes) == a).all()


@FEW
@given(st.integers(1, 11), st.integers(1, 9), st.sampled_from([*sorted(EXPECTED), "stride"]), st.integers(0, 99))
def test_chunks_pool_as_cells_do(spark, h, w, method, seed):
    a = np.random.default_rng(seed).integers(-4, 5, (h, w))
    sizes, chunk, factors = {"y": h, "x": w}, {"y": 4, "x": 6}, {"y": 2, "x": 3}
    size = {"y": -(-h // 2), "x": -(-w // 3)}
    pooled = K.pool_chunks(A.to_chunks(frame(spark, a, "yx"), sizes, chunk), chunk, factors, sizes, method)
    want = a[::2, ::3] if method == "stride" else EXPECTED[method](padded_blocks(a, 2, 3))
    assert (C.dense(A.to_cells(pooled, chunk), size) == want).all()
    doubled = K.map_chunks(A.to_chunks(frame(spark, a, "yx"), sizes, chunk), lambda v: v * 2)
    assert (C.dense(A.to_cells(doubled, chunk), sizes) == a * 2).all()


@FEW
@given(st.integers(1, 13), st.integers(1, 12), st.integers(1, 5), st.integers(1, 7), st.integers(1, 4), st.integers(1, 3), st.sampled_from([*sorted(EXPECTED), "stride"]), st.integers(0, 99))
def test_blocks_over_chunk_borders_pool_as_cells_do(spark, h, w, cy, cx, fy, fx, method, seed):
    a = np.random.default_rng(seed).integers(-2, 3, (h, w))
    a[: h // 2] = 0  # chunks that aren't held
    sizes, chunk = {"y": h, "x": w}, {"y": cy, "x": cx}
    size = {"y": -(-h // fy), "x": -(-w // fx)}
    pooled = K.pool_chunks(A.to_chunks(frame(spark, a, "yx"), sizes, chunk), chunk, {"y": fy, "x": fx}, sizes, method)
    want = a[::fy, ::fx] if method == "stride" else EXPECTED[method](padded_blocks(a, fy, fx))
    assert (C.dense(A.to_cells(pooled, chunk), size) == want).all()


def test_shared_blocks_with_nan(spark):
    a = np.array([[1.0, 2.0, np.nan, 4.0, 5.0, 6.0, 0.0]])
    sizes, chunk = {"y": 1, "x": 7}, {"y": 1, "x": 3}
    out = C.dense(A.to_cells(K.pool_chunks(A.to_chunks(frame(spark, a, "yx"), sizes, chunk), chunk, {"x": 2}, sizes), chunk), {"y": 1, "x": 4})
    assert np.isnan(out[0, 1]) and out[0, [0, 2, 3]].tolist() == [1.5, 5.5, 0.0]


@FEW
@given(st.tuples(*[st.integers(1, 7)] * 3), st.tuples(*[st.integers(1, 4)] * 3), st.tuples(*[st.integers(1, 9)] * 3), st.integers(0, 99))
def test_rechunking_keeps_every_cell(spark, shape, old, new, seed):
    a = np.random.default_rng(seed).integers(0, 3, shape)
    sizes, chunk, to = (dict(zip("zyx", x, strict=True)) for x in (shape, old, new))
    out = K.rechunk(A.to_chunks(frame(spark, a, "zyx"), sizes, chunk), chunk, to, sizes)
    assert (C.dense(A.to_cells(out, to), sizes) == a).all()
    for r in out.collect():
        assert r["shape"] == K.extents([r["z_chunk"], r["y_chunk"], r["x_chunk"]], new, shape)


def planes(spark, shape):
    """One chunk row for each plane of a ramp of 16-bit numbers."""
    (z, y, x), axes = shape, ("t", "c", "z", "y", "x")

    def ramp(batches):
        for pdf in batches:
            for k in pdf["id"]:
                values = (np.arange(y * x, dtype=np.int64) + k * y * x).astype(np.uint16).astype(np.int32)
                yield pd.DataFrame({**{f"{a}_chunk": [k if a == "z" else 0] for a in axes}, "shape": [[1, 1, 1, y, x]], "values": [values]})

    schema = ", ".join(f"{a}_chunk long" for a in axes) + ", shape array<int>, values array<int>"
    return spark.range(z).mapInPandas(ramp, schema), dict(zip(axes, (1, 1, 1, y, x), strict=True)), dict(zip(axes, (1, 1, z, y, x), strict=True))


@pytest.mark.parametrize(("shape", "depth"), [((50, 512, 512), 50), ((50, 512, 512), 32), ((1187, 64, 64), 512)])
def test_planes_become_volumes(spark, shape, depth):
    chunks, chunk, sizes = planes(spark, shape)
    to = sizes | {"z": depth}
    plane = shape[1] * shape[2]

    def digest(batches):
        for batch in batches:
            rows = [(k, s[2], bool((v == (np.arange(len(v), dtype=np.int64) + k * depth * plane).astype(np.uint16)).all())) for k, s, v in zip(batch["z_chunk"].to_pylist(), batch["shape"].to_pylist(), K.rows_of(batch["values"]), strict=True)]
            yield pa.RecordBatch.from_pylist([{"z": z, "n": n, "same": same} for z, n, same in rows], pa.schema([("z", pa.int64()), ("n", pa.int32()), ("same", pa.bool_())]))

    got = K.rechunk(chunks, chunk, to, sizes).mapInArrow(digest, "z long, n int, same boolean").collect()
    assert {(r["z"], r["n"], r["same"]) for r in got} == {(k, min(depth, shape[0] - k * depth), True) for k in range(-(-shape[0] // depth))}


def test_writing_a_chunk_takes_time_in_proportion_to_its_cells(spark):
    def seconds(z):
        sizes = {"z": z, "y": 256, "x": 256}
        cells = C.grid(spark, sizes).withColumn("value", (F.col("z") * 7 + F.col("y") * 3 + F.col("x") + 1).cast("int"))
        began = time.perf_counter()
        row = A.to_chunks(cells, sizes, {"z": 16, "y": 256, "x": 256}).select("shape", F.size("values").alias("n"), F.col("values")[70_000].alias("v")).collect()
        assert len(row) == 1 and row[0]["n"] == z * 65536 and row[0]["v"] == 7 + 3 * (4464 // 256) + 4464 % 256 + 1
        return time.perf_counter() - began

    seconds(2)
    few, many = seconds(2), seconds(16)
    assert many < 30 and many < 16 * max(few, 0.5)


def test_chunks_refuse_cells_outside_and_twice(spark):
    sizes, chunk = {"y": 2, "x": 2}, {"y": 2, "x": 1}
    for bad in ([(0, 2, 1)], [(-1, 0, 1)], [(0, 0, 1), (0, 0, 2)]):
        with pytest.raises(Exception, match="outside|twice"):
            A.to_chunks(spark.createDataFrame(bad, "y long, x long, value long"), sizes, chunk).collect()
    some = spark.createDataFrame([(0, 0, None), (1, 1, 2.5)], "y long, x long, value double")
    assert [r["values"] for r in A.to_chunks(some, sizes, chunk, fill=0.5).collect()] == [[0.5, 2.5]]
    words = spark.createDataFrame([(1, 0, "b")], "y long, x long, value string")
    assert [r["values"] for r in A.to_chunks(words, sizes, chunk, fill="-").collect()] == [["-", "b"]]
    assert A.to_chunks(some.limit(0), sizes, chunk).collect() == []


def test_rows_become_chunks_with_any_fill(spark):
    rows = spark.createDataFrame([(0, [1.5, 2.5, 9.0]), (2, [4.0]), (2, [4.0]), (3, None), (7, [1.0]), (1, [])], "r long, a array<double>")
    sizes, chunk = {"y": 4, "x": 2}, {"y": 2, "x": 2}
    out = K.from_rows(rows, "r", "a", lambda v: v, chunk, sizes, 0.5)
    assert C.dense(A.to_cells(out, chunk), sizes, 0.5).tolist() == [[1.5, 2.5], [0.5, 0.5], [4.0, 0.5], [0.5, 0.5]]


@FEW
@given(st.integers(-8, 8), st.integers(-8, 12), st.integers(1, 3), st.lists(st.integers(-6, 5), max_size=7), st.integers(1, 9), st.integers(1, 7))
def test_selection_of_chunks_is_numpys(spark, start, stop, step, picks, cy, cx):
    a = np.arange(1, 49).reshape(8, 6)
    sizes, chunk = {"y": 8, "x": 6}, {"y": cy, "x": cx}
    held = A.to_chunks(frame(spark, a, "yx"), sizes, chunk)
    out, goal, size = K.select(held, chunk, sizes, y=slice(start, stop, step), x=picks)
    want = a[start:stop:step][:, picks]
    assert size == {"y": want.shape[0], "x": want.shape[1]}
    assert (C.dense(A.to_cells(out, goal), size) == want).all() if want.size else out.count() == 0


def test_a_chunk_selection_drops_axes_and_refuses_what_is_outside(spark):
    a = np.arange(1, 25).reshape(2, 3, 4)
    sizes, chunk = {"t": 2, "y": 3, "x": 4}, {"t": 1, "y": 2, "x": 3}
    held = A.to_chunks(frame(spark, a, "tyx"), sizes, chunk)
    out, goal, size = K.select(held, chunk, sizes, t=-1, x=[3, 0, 3])
    assert (C.dense(A.to_cells(out, goal), size) == a[-1][:, [3, 0, 3]]).all()
    for bad in ({"t": 2}, {"y": [0, -4]}, {"t": 0, "y": 0, "x": 0}):
        with pytest.raises((IndexError, ValueError)):
            K.select(held, chunk, sizes, **bad)


def test_selection_and_emptiness_reach_the_scan(spark, tmp_path):
    a = np.zeros((8, 8), dtype=int)
    a[2:4, 4:] = [[0, 5, 0, -1], [0, 0, 3, 0]]
    a[6:, :4] = 9
    sizes, chunk, path = {"y": 8, "x": 8}, {"y": 2, "x": 4}, str(tmp_path / "a")
    A.write(K.with_range(A.to_chunks(frame(spark, a, "yx"), sizes, chunk, fill=-7)), path)
    held = spark.read.parquet(path)
    assert held.count() == 8 and K.not_empty(held).count() == 2
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = K.not_empty(K.touched(held, chunk, sizes, y=[2, 7, 3], x=slice(4, 8)))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters") :]
    assert "In(y_chunk, [1,3])" in pushed and "GreaterThanOrEqual(x_chunk,1)" in pushed
    assert "LessThan(low,0)" in pushed and "GreaterThan(high,0)" in pushed
    out, goal, size = K.select(K.not_empty(held), chunk, sizes, y=[7, 2, 3], x=slice(2, 7))
    assert (C.dense(A.to_cells(out, goal), size) == a[[7, 2, 3], 2:7]).all()


def test_empty_blocks_are_told_by_ranges(spark):
    nan = float("nan")
    a = np.zeros((5, 2, 1, 4))
    a[0] = 1  # full
    a[1, 0] = 1  # channel 1 is all zero, and not held
    a[2, 0], a[2, 1] = 1, nan  # channel 1 is all NaN
    a[3, 0], a[3, 1, 0] = 2, [nan, nan, 0, 0]  # NaN in one chunk, zeros in one that isn't held
    a[4, 0], a[4, 1, 0] = [0, 0, 0, 3], [nan, 0, -1, 0]
    sizes, chunk = dict(zip("tcyx", a.shape, strict=True)), {"t": 1, "c": 1, "y": 1, "x": 2}
    held = A.to_chunks(frame(spark, a, "tcyx"), sizes, chunk)
    kept = K.drop_empty(K.with_range(held), chunk, sizes, ["t"], "c")
    assert {r["t_chunk"] for r in kept.collect()} == {0, 3, 4}
    same = C.drop_empty(frame(spark, a, "tcyx"), ["t"], "c")
    assert {r["t"] for r in same.collect()} == {0, 3, 4}
    with pytest.raises(ValueError):
        K.drop_empty(K.with_range(held), chunk | {"c": 2}, sizes, ["t"], "c")


def test_stored_chunks_are_pruned(spark, tmp_path):
    a = np.arange(1, 65).reshape(8, 8)
    chunk = {"y": 2, "x": 4}
    A.write(A.to_chunks(frame(spark, a, "yx"), {"y": 8, "x": 8}, chunk, {"y": 4, "x": 8}), str(tmp_path / "a"))
    part = A.read(spark, str(tmp_path / "a"), chunk, {"y": (3, 6)})
    assert sorted(r["value"] for r in part.collect()) == sorted(a[3:6].ravel().tolist())
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(y_chunk,1)" in plan and "LessThanOrEqual(y_chunk,2)" in plan


def test_coordinates(spark):
    row = spark.range(1).select(
        coords.coordinates(F.lit(3).cast("long"), F.lit(0.5), F.lit(1.0)).alias("c"),
        coords.coordinates(F.lit(0).cast("long"), F.lit(0.5), F.lit(1.0)).alias("none"),
        coords.index_of(F.lit(2.25), F.lit(0.5), F.lit(1.0)).alias("i"),
        coords.infer_scale(F.array(F.lit(2.0), F.lit(2.5))).alias("s"),
        coords.infer_scale(F.array(F.lit(2.0))).alias("one"),
    ).first()
    assert (row["c"], row["none"], row["i"], row["s"], row["one"]) == ([1.0, 1.5, 2.0], [], 2, 0.5, 1.0)
    assert len(coords.SPACE_UNITS) == 26 and len(coords.TIME_UNITS) == 23
    fine = lambda kind, unit: spark.range(1).select(coords.valid_unit(F.lit(kind), F.lit(unit).cast("string"))).first()[0]
    assert fine("space", "micrometer") and fine("time", "second") and fine("channel", "any") and fine("space", None)
    assert not fine("space", "second") and not fine("time", "micrometer")
    rows = coords.exploded(spark.createDataFrame([(0, 25), (1, 0)], "k long, n long"), "n", F.lit(0.5), F.lit(1.0), 10).collect()
    assert sorted((r["k"], r["i"], r["coord"]) for r in rows) == [(0, i, 1.0 + i * 0.5) for i in range(25)]


def test_labelled_writes_by_coordinate_and_name(spark):
    cells = spark.createDataFrame([(t, c, 10 * t + c) for t in range(3) for c in range(2)], "t long, c long, value long")
    known = spark.createDataFrame([("BF", 0), ("GFP", 1)], "name string, index long")
    data = spark.createDataFrame([(2.1, "GFP", 99), (0.0, "BF", 77), (6.0, "BF", 55)], "t_coord double, c_name string, value long")
    out = {(r["t"], r["c"]): r["value"] for r in coords.write_labelled(cells, data, ["t", "c"], {"t": (2.0, 0.0)}, {"c": known}).collect()}
    assert out == {(0, 0): 77, (0, 1): 1, (1, 0): 10, (1, 1): 99, (2, 0): 20, (2, 1): 21, (3, 0): 55}
    with pytest.raises(Exception, match="no such c"):
        coords.write_labelled(cells, data.withColumn("c_name", F.lit("x")), ["t", "c"], {"t": (2.0, 0.0)}, {"c": known}).collect()


def test_transforms_of_one_image_or_all(spark):
    old = spark.createDataFrame([("0", 0, "scale", [2.0]), ("0", 1, "translation", [1.0]), ("1", 0, "scale", [3.0])], "image string, ordinal long, type string, values array<double>")
    out = {(r["image"], r["ordinal"]): (r["type"], r["values"]) for r in coords.replace_transforms(old, "0", [("scale", [5.0])]).collect()}
    assert out == {("0", 0): ("scale", [5.0]), ("1", 0): ("scale", [3.0])}
    assert {r["image"] for r in coords.replace_transforms(old, "*", [("scale", [5.0])]).filter("values[0] = 5.0").collect()} == {"0", "1"}


def test_zeros_are_metadata_alone(spark):
    levels = spark.createDataFrame([(0, 0, [4, 4], "uint16", [1.0, 1.0])], "image long, level long, shape array<bigint>, dtype string, scale array<double>")
    images = spark.createDataFrame([(0, [2, 2], "uint16"), (1, [8, 8], "float32")], "image long, shape array<bigint>, dtype string")
    out = {(r["image"], r["level"]): (r["shape"], r["scale"]) for r in A.create_zeros(levels, images, [2.0, 2.0]).collect()}
    assert out == {(0, 0): ([4, 4], [1.0, 1.0]), (0, 1): ([2, 2], [2.0, 2.0]), (1, 0): ([8, 8], [2.0, 2.0])}
    with pytest.raises(Exception, match="number of axes"):
        A.create_zeros(levels, images.withColumn("shape", F.array(F.lit(1).cast("long"))), [1.0, 1.0]).collect()


def test_images_are_created_with_their_levels(spark, tmp_path):
    none = spark.createDataFrame([], "image string, level long, shape array<bigint>, dtype string, scale array<double>")
    a = np.arange(1, 31).reshape(5, 6)
    sizes, path = {"y": 5, "x": 6}, str(tmp_path / "p.zarr")
    levels = A.create_image(none, path, "A", frame(spark, a, "yx"), sizes, {"y": 2, "x": 99}, [0.5, 0.25], "int64")
    levels = A.create_image(levels, path, "A", frame(spark, a[::2, ::2], "yx"), {"y": 3, "x": 3}, {"y": 2, "x": 2}, [1.0, 0.5], "int64")
    assert sorted((r["image"], r["level"], r["shape"], r["scale"]) for r in levels.collect()) == [("A", 0, [5, 6], [0.5, 0.25]), ("A", 1, [3, 3], [1.0, 0.5])]
    assert (C.dense(A.read(spark, f"{path}/image=A/level=0", {"y": 2, "x": 6}), sizes) == a).all()
    assert (C.dense(A.read(spark, f"{path}/image=A/level=1", {"y": 2, "x": 2}), {"y": 3, "x": 3}) == a[::2, ::2]).all()
    assert {"low", "high"} <= set(spark.read.parquet(f"{path}/image=A/level=0").columns)
    cells = frame(spark, a, "yx")
    for bad in ({"scale": [1.0]}, {"scale": [1.0, 0.0]}, {"chunk": {"y": 0, "x": 1}}, {"chunk": {"y": 1}}):
        with pytest.raises(ValueError):
            A.create_image(none, path, "B", cells, sizes, **({"chunk": {"y": 2, "x": 2}, "scale": [1.0, 1.0], "dtype": "int64"} | bad))
    with pytest.raises(Exception, match="outside"):
        A.create_image(none, path, "C", cells, {"y": 4, "x": 6}, {"y": 2, "x": 2}, [1.0, 1.0], "int64")
    with pytest.raises(Exception, match="number of axes"):
        A.create_image(levels, path, "A", frame(spark, a[None], "zyx"), {"z": 1, **sizes}, {"z": 1, "y": 2, "x": 2}, [1.0] * 3, "int64").collect()


def test_stores_are_guarded(spark, tmp_path):
    sizes = {"y": 4, "x": 4}
    chunks = A.to_chunks(spark.createDataFrame([(0, 0, 5), (3, 3, 7)], "y long, x long, value long"), sizes, {"y": 2, "x": 2})
    plain, store = str(tmp_path / "plain"), str(tmp_path / "a.zarr")
    for path in (plain, store):
        A.write(chunks, path)
        with pytest.raises(Exception, match="(?i)exist"):
            A.write(chunks, path)
    A.write(chunks, store, "w")
    with pytest.raises(Exception, match="(?i)exist"):
        A.write(chunks, plain, "w")
    with pytest.raises(ValueError):
        A.write(chunks, plain, "r")
    assert A.read(spark, store, {"y": 2, "x": 2}).filter("value > 0").count() == 2


def test_positions_are_processed_by_index_and_resumed(spark):
    cells = spark.createDataFrame([(p, t, y, 100 * p + 10 * t + y) for p in range(2) for t in range(3) for y in range(2)], "p long, t long, y long, value long")
    seen = lambda v, input_time_index: v * 2 + input_time_index
    out = volumes.process_positions(cells, seen, ["p", "t"], {"y": 2}, {"t": [(2, 0), (0, 1)]})
    want = {(p, o, y): 2 * (100 * p + 10 * i + y) + i for p in range(2) for i, o in ((2, 0), (0, 1)) for y in range(2)}
    assert {(r["p"], r["t"], r["y"]): r["value"] for r in out.collect()} == want
    done = spark.createDataFrame([(1, 0)], "p long, t_out long")
    again = volumes.process_positions(cells, seen, ["p", "t"], {"y": 2}, {"t": [(2, 0), (0, 1)]}, done)
    assert {(r["p"], r["t"], r["y"]): r["value"] for r in again.collect()} == {k: v for k, v in want.items() if k[:2] != (1, 0)}


def test_set_scale_keeps_history(spark):
    images = spark.createDataFrame([("0", [5.0, 4.0, 3.0], [1.0]), ("1", [5.0, 4.0, 3.0], [1.0])], "name string, scale array<double>, t array<double>").withColumn("history", F.array().cast("array<array<double>>"))
    out = {r["name"]: r for r in coords.set_scale(images, 2, 10.0, F.col("name") == "1").collect()}
    assert out["1"]["scale"] == [5.0, 4.0, 10.0] and out["1"]["history"] == [[5.0, 4.0, 3.0]] and out["0"]["scale"][2] == 3.0
    with pytest.raises(ValueError):
        coords.set_scale(images, 0, 0.0, F.lit(True))
