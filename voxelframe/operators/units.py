"""Mapped units of work that write to a store and resume: begin, write, complete.

A unit is one output time of one channel group of a position. A run appends to the ledger that
its units begin, writes their chunk rows to a folder of its own, each unit with a record of the
shards it wrote, and appends that they are complete. Folders are committed as a whole by Spark's
writer, and no run writes to another's, so a run that dies leaves its units in flight: a reader
doesn't see what they wrote, and the next run makes them again. Nothing is locked or deleted.

Store: ``ledger`` (events) and ``chunks/run=<n>``.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.operators.chunks import _cuts, _put, element, extents, lists, rows_of
from voxelframe.operators.shards import complete_units, unit_name

AXES = ("t", "c", "z", "y", "x")
KEYS = [f"{a}_chunk" for a in AXES]
#: Units that one job writes and commits together.
WAVE = 100_000
UNIT = ("unit", "position", "t_in", "t_out", "c_in", "c_out")
EVENT = "run long, event string, unit string, position string, t_in long, t_out long, c_in array<long>, c_out array<long>, shards array<string>"


def _events(spark: SparkSession, store: str) -> DataFrame:
    spark.createDataFrame([], EVENT).write.mode("ignore").parquet(f"{store}/ledger")
    return spark.read.schema(EVENT).parquet(f"{store}/ledger")


def plan(positions: DataFrame, times: Sequence[tuple[int, int]], channels: Sequence[tuple[Sequence[int], Sequence[int]]], token: str = "") -> DataFrame:
    """The units of all positions: each pair of an input and an output time with each pair of channel groups.

    ``token`` says what else determines the output; it is part of a unit's name, so that a unit of
    other settings is another unit.
    """
    long = lambda x: F.lit(x).cast("long")
    pairs = [F.struct(long(i).alias("t_in"), long(o).alias("t_out")) for i, o in times]
    groups = [F.struct(F.array(*map(long, i)).alias("c_in"), F.array(*map(long, o)).alias("c_out")) for i, o in channels]
    rows = positions.select("position").distinct().select("position", F.explode(F.array(*pairs)).alias("t"))
    rows = rows.select("position", "t.*", F.explode(F.array(*groups)).alias("c")).select("position", "t_in", "t_out", "c.*")
    text = lambda *names: F.to_json(F.struct(*names))
    return rows.withColumn("unit", unit_name(text("position", "t_in", "t_out"), text("c_in", "c_out"), F.lit(token)))


def states(spark: SparkSession, store: str) -> DataFrame:
    """(unit, state, run): ``complete`` or ``in flight``, by the unit's last run."""
    last = _events(spark, store).groupBy("unit").agg(F.max(F.struct("run", (F.col("event") == "complete").alias("done"))).alias("last"))
    return last.select("unit", F.when(F.col("last.done"), "complete").otherwise("in flight").alias("state"), F.col("last.run").alias("run"))


def completed(spark: SparkSession, store: str) -> DataFrame:
    """Units whose last run is complete, and whose recorded shards are exactly those that are stored; so they don't pass once data are lost."""
    done = states(spark, store).filter("state = 'complete'").select("unit", "run")
    events = _events(spark, store).filter("event = 'complete'").join(done, ["unit", "run"])
    recorded = events.select("unit", F.explode("shards").alias("shard"))
    stored = _chunks(spark, store).join(done, ["unit", "run"], "left_semi").select("unit", "shard")
    same = complete_units(recorded, stored, done)
    # A unit that wrote nothing has neither.
    none = events.filter(F.size("shards") == 0).select("unit").join(stored, "unit", "left_anti")
    return same.filter("complete").select("unit").unionByName(none)


def _chunks(spark: SparkSession, store: str) -> DataFrame:
    """The chunk rows of all runs, complete or not."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(f"{store}/chunks").filter("shard is not null")
    except AnalysisException:  # no run has come so far
        return spark.createDataFrame([], "unit string, shard string, run long")


def read(spark: SparkSession, store: str) -> DataFrame:
    """The store's chunk rows (``position``, ``run`` and as ``sources.arrays``): at each position, time and channel those of the last complete run."""
    ledger = _events(spark, store).filter("event = 'complete'")
    last = ledger.select("position", F.col("t_out").alias("t_chunk"), F.explode("c_out").alias("c_chunk"), "run").groupBy("position", "t_chunk", "c_chunk").agg(F.max("run").alias("run"))
    held = spark.read.parquet(f"{store}/chunks").filter("shard is not null").withColumn("run", F.col("run").cast("long"))
    return held.join(last, ["position", "t_chunk", "c_chunk", "run"], "left_semi").select("position", "run", *KEYS, "shard", "shape", "values")


def _mapped(source: DataFrame, units: DataFrame, func: Callable, chunk: Sequence[int], size: Sequence[int], to: Sequence[int], out: Sequence[int], made_of: str | None, fill, options: Mapping) -> DataFrame:
    """Chunk rows of the units' outputs, and for each unit a row without a shard that records those it wrote."""
    kind, arrow = element(source)
    if made_of:
        kind, arrow = element(source.select(F.array(F.lit(None).cast(made_of)).alias("values")))
    wants_time = "input_time_index" in inspect.signature(func).parameters
    t = F.floor(F.col("t_in") / chunk[0]).cast("long").alias("t_chunk")
    c = F.explode(F.array_distinct(F.transform("c_in", lambda i: F.floor(i / chunk[1]).cast("long")))).alias("c_chunk")
    asked = units.select("unit", "position", "t_in", "t_out", "c_in", "c_out", t, c)
    rows = source.select("position", *KEYS, "shape", "values").join(asked, ["position", "t_chunk", "c_chunk"])
    names = ["unit", "position", *KEYS, "shard", "shape", "values", "shards"]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        first = lambda n: table[n][0].as_py()
        t_in, t_out, c_in, c_out = first("t_in"), first("t_out"), first("c_in"), first("c_out")
        volume = None
        for i in range(table.num_rows):
            at, values = [table[k][i].as_py() for k in KEYS], table["values"].slice(i, 1)
            part = rows_of(values)[0].reshape(table["shape"][i].as_py())
            if volume is None:
                volume = np.full([len(c_in), *size[2:]], fill, dtype=part.dtype)
            here = part[t_in - at[0] * chunk[0]]
            places = [np.arange(k * w, k * w + n) for k, w, n in zip(at[2:], chunk[2:], here.shape[1:], strict=True)]
            for k, c in enumerate(c_in):
                if 0 <= c - at[1] * chunk[1] < here.shape[0]:
                    _put(volume[k], places, here[c - at[1] * chunk[1]].ravel())
        made = []
        flat = volume.reshape(len(c_in), -1)
        # A channel of nothing but zeros or NaN: the unit is left out.
        if not ((flat == 0).all(axis=1) | (flat != flat).all(axis=1)).any():
            result = np.asarray(func(volume, **({"input_time_index": t_in} if wants_time else {}), **options))
            if result.shape != (len(c_out), *out[2:]):
                raise ValueError(f"the function returned {result.shape} for {(len(c_out), *out[2:])}")
            result = result.astype(arrow.to_pandas_dtype())
            for k, c in enumerate(c_out):
                for piece in product(*(_cuts(0, n, w) for n, w in zip(out[2:], to[2:], strict=True))):
                    own = result[k][tuple(slice(a, b) for a, b in piece)]
                    if not (own == fill).all():
                        made.append(([t_out, c, *(a // w for (a, _), w in zip(piece, to[2:], strict=True))], own[None, None]))
        n, shards = len(made) + 1, ["_".join(map(str, at)) for at, _ in made]
        keys = [pa.array([at[k] for at, _ in made] + [None], pa.int64()) for k in range(5)]
        return pa.table(
            [
                pa.array([key[0].as_py()] * n),
                pa.array([first("position")] * n, pa.string()),
                *keys,
                pa.array([*shards, None], pa.string()),
                lists([*(np.array(a.shape) for _, a in made), np.empty(0, int)], pa.int32()),
                lists([*(a for _, a in made), np.empty(0, int)], arrow),
                pa.array([None] * len(made) + [shards], pa.list_(pa.string())),
            ],
            names,
        )

    schema = f"unit string, position string, {', '.join(f'{k} long' for k in KEYS)}, shard string, shape array<int>, values array<{kind}>, shards array<string>"
    return rows.groupBy("unit").applyInArrow(run, schema)


def _begin(units: DataFrame, store: str, run: int) -> DataFrame:
    """Append that a run's units begin; returns them as the ledger has them."""
    spark = units.sparkSession
    rows = units.select(F.lit(run).cast("long").alias("run"), F.lit("begin").alias("event"), *UNIT, F.lit(None).cast("array<string>").alias("shards"))
    rows.write.mode("append").parquet(f"{store}/ledger")
    return _events(spark, store).filter((F.col("run") == run) & (F.col("event") == "begin"))


def _complete(begun: DataFrame, store: str, run: int) -> None:
    """Append that a run's units are complete, with the shards that were committed for each."""
    written = begun.sparkSession.read.parquet(f"{store}/chunks/run={run}").filter("shard is null").select("unit", F.col("shards").alias("wrote"))
    rows = begun.join(written, "unit", "left").withColumns({"event": F.lit("complete"), "shards": F.coalesce("wrote", F.array().cast("array<string>"))})
    rows.select(*begun.columns).write.mode("append").parquet(f"{store}/ledger")


def process(
    source: DataFrame,
    store: str,
    func: Callable,
    chunk: Mapping[str, int],
    sizes: Mapping[str, int],
    times: Sequence[tuple[int, int]] | None = None,
    channels: Sequence[tuple[Sequence[int], Sequence[int]]] | None = None,
    to: Mapping[str, int] | None = None,
    out_sizes: Mapping[str, int] | None = None,
    kind: str | None = None,
    resume: bool = False,
    token: str = "",
    wave: int = WAVE,
    fill=0,
    **options,
) -> int:
    """Map ``func`` over times and channel groups of all positions and write the results; returns how many units were made.

    ``source`` has chunk rows over t, c, z, y, x with a ``position``. ``func`` takes the array of a
    channel group (c, z, y, x), and ``input_time_index`` if it wants it, and returns one of as many
    output channels. A group of which a channel is all zero or all NaN isn't handed over and
    writes nothing. ``to`` and ``out_sizes`` are the output's chunk and sizes, ``kind`` its type;
    they are the input's where not given. ``times`` and ``channels`` pair inputs with outputs: all
    times, and each channel by itself, where not given. With ``resume``, units that are complete
    under the same token aren't made again. Units are made in waves, each committed by itself.
    """
    spark = source.sparkSession
    to, out_sizes = dict(to or chunk) | {"t": 1, "c": 1}, dict(out_sizes or sizes)
    times = [(t, t) for t in range(sizes["t"])] if times is None else list(times)
    channels = [([c], [c]) for c in range(sizes["c"])] if channels is None else list(channels)
    for name, pairs, most in (("t", [(i, o) for i, o in times], (sizes["t"], out_sizes["t"])), ("c", [(i, o) for a, b in channels for i, o in zip(a, b, strict=True)], (sizes["c"], out_sizes["c"]))):
        if any(not (0 <= i < most[0] and 0 <= o < most[1]) for i, o in pairs):
            raise ValueError(f"an index on axis {name} beyond {most}")
    if len({o for _, o in times}) < len(times) or len({o for _, b in channels for o in b}) < sum(len(b) for _, b in channels):
        raise ValueError("two units would write to one place")
    if not times or not channels:
        return 0
    units = plan(source.select("position"), times, channels, token)
    if resume:
        units = units.join(completed(spark, store), "unit", "left_anti")
    waves = -(-units.count() // wave)
    known = _events(spark, store).agg(F.coalesce(F.max("run"), F.lit(0))).first()[0]
    shape = lambda x: [x[a] for a in AXES]
    made = 0
    for k in range(waves):
        run = known + 1 + k
        begun = _begin(units.filter(F.pmod(F.xxhash64("unit"), F.lit(waves)) == k), store, run)
        _mapped(source, begun, func, shape(chunk), shape(sizes), shape(to), shape(out_sizes), kind, fill, options).write.parquet(f"{store}/chunks/run={run}")
        _complete(begun, store, run)
        made += begun.count()
    return made
