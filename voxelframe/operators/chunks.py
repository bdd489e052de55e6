"""Kernels on chunk rows: cutting, joining, selecting, pooling and user functions without taking arrays apart into cells.

Chunk rows are those of ``sources.arrays``: ``<axis>_chunk``, ``shard``, ``shape``, ``values``. A
missing chunk reads as the fill value, and pools to it, so sparse arrays stay sparse.

What moves between chunks moves as parts: a part has the number of the chunk that it goes to, its
places there on each axis, and its cells. Parts of one chunk meet in one task, which is bounded
by the chunk's shape.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelframe.operators.pool import METHODS

Index = int | slice | Sequence[int]
#: Cells that rows are cut for at a time: what a task holds beside its Arrow batch.
STEP_CELLS = 1 << 16


def rows_of(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    """Each row's values of a list column, as views."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, ends = column.values.to_numpy(zero_copy_only=False), np.asarray(column.offsets).tolist()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def lists(rows: Sequence[np.ndarray], kind: pa.DataType) -> pa.Array:
    """Arrays as one list column."""
    ends = np.concatenate([[0], np.cumsum([np.size(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate([np.ravel(r) for r in rows]) if len(rows) else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat).cast(kind))


def element(chunks: DataFrame) -> tuple[str, pa.DataType]:
    """The type of a chunk's cells, for Spark and for Arrow."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = chunks.schema["values"].dataType.elementType
    return kind.simpleString(), to_arrow_type(kind)


def extents(at: Sequence[int], chunk: Sequence[int], size: Sequence[int]) -> list[int]:
    """The shape of a chunk, which ends where the array does."""
    return [min(w, n - i * w) for i, w, n in zip(at, chunk, size, strict=True)]


def shard_name(keys: Sequence[str], chunk: Mapping[str, int], shard: Mapping[str, int] | None = None) -> Column:
    parts = shard or chunk
    return F.concat_ws("_", *[F.floor(F.col(k) * chunk[a] / parts[a]).cast("long").cast("string") for k, a in zip(keys, chunk, strict=True)])


def _all_fill(a: np.ndarray, fill) -> bool:
    return bool(((a == fill) | ((a != a) & (fill != fill))).all())


def _put(out: np.ndarray, at: Sequence[np.ndarray], values: np.ndarray) -> None:
    """Values to their places on each axis; places in a row are a slice."""
    where = [slice(int(x[0]), int(x[0]) + len(x)) if (np.diff(x) == 1).all() else x for x in at]
    shape = [len(x) for x in at]
    if all(isinstance(w, slice) for w in where):
        out[tuple(where)] = values.reshape(shape)
    else:
        out[np.ix_(*at)] = values.reshape(shape)


class _Parts:
    """Parts on their way into one Arrow batch."""

    def __init__(self, keys: Sequence[str], kind: pa.DataType):
        self.names, self.kind = [*keys, "lengths", "places", "values"], kind
        self.rows: list[tuple] = []

    def add(self, key: Sequence[int], at: Sequence[np.ndarray], values: np.ndarray) -> None:
        self.rows.append((key, at, values))

    def batch(self, *more: tuple[str, pa.Array]) -> pa.RecordBatch:
        keys = np.array([k for k, _, _ in self.rows], dtype=np.int64).reshape(len(self.rows), len(self.names) - 3)
        lengths = lists([np.array([len(x) for x in at]) for _, at, _ in self.rows], pa.int32())
        places = lists([np.concatenate(at) for _, at, _ in self.rows], pa.int32())
        values = lists([v for _, _, v in self.rows], self.kind)
        return pa.RecordBatch.from_arrays([*(pa.array(k) for k in keys.T), lengths, places, values, *(c for _, c in more)], [*self.names, *(n for n, _ in more)])


def _schema(keys: Sequence[str], kind: str) -> str:
    return ", ".join(f"{k} long" for k in keys) + f", lengths array<int>, places array<int>, values array<{kind}>"


def _given(table: pa.Table) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """The places on each axis and the values of a table's parts."""
    for lengths, places, values in zip(rows_of(table["lengths"]), rows_of(table["places"]), rows_of(table["values"]), strict=True):
        yield np.split(places, np.cumsum(lengths)[:-1]), values


def assemble(parts: DataFrame, chunk: Mapping[str, int], sizes: Mapping[str, int], fill=0, shard: Mapping[str, int] | None = None) -> DataFrame:
    """Parts as chunk rows. Cells that no part holds are the fill value; chunks of it alone aren't kept."""
    keys = [f"{a}_chunk" for a in chunk]
    width, size = list(chunk.values()), [sizes[a] for a in chunk]
    kind, arrow = element(parts)
    names = [*keys, "shape", "values"]

    def join(key: tuple, table: pa.Table) -> pa.Table:
        at = [k.as_py() for k in key]
        out = None
        for places, values in _given(table):
            if out is None:
                out = np.full(extents(at, width, size), fill, dtype=values.dtype)
            _put(out, places, values)
        made = [] if _all_fill(out, fill) else [out]
        columns = [*(pa.array([k] * len(made), pa.int64()) for k in at), lists([np.array(a.shape) for a in made], pa.int32()), lists(made, arrow)]
        return pa.table(columns, names)

    made = parts.groupBy(*keys).applyInArrow(join, ", ".join(f"{k} long" for k in keys) + f", shape array<int>, values array<{kind}>")
    return made.select(*keys, shard_name(keys, chunk, shard).alias("shard"), "shape", "values")


def _cuts(start: int, stop: int, width: int) -> list[tuple[int, int]]:
    """A range cut at the multiples of ``width``."""
    ends = [start, *range((start // width + 1) * width, stop, width), stop]
    return list(zip(ends[:-1], ends[1:], strict=True))


def rechunk(chunks: DataFrame, chunk: Mapping[str, int], to: Mapping[str, int], sizes: Mapping[str, int], fill=0, shard: Mapping[str, int] | None = None) -> DataFrame:
    """The same array in chunks of another shape; ``shard`` is the new shards' shape.

    Each chunk is cut where the new chunks end, and the slices are joined: what is shuffled is the
    array once, in rows of slices. No row is made for a cell.
    """
    if any(n < 1 for n in to.values()):
        raise ValueError(f"chunks of {dict(to)}")
    axes = list(chunk)
    keys = [f"{a}_chunk" for a in axes]
    width, new = [chunk[a] for a in axes], [to[a] for a in axes]
    kind, arrow = element(chunks)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = zip(*(batch.column(k).to_pylist() for k in keys), strict=True)
            for key, shape, values in zip(at, rows_of(batch.column("shape")), rows_of(batch.column("values")), strict=True):
                a, first, parts = values.reshape(shape), [i * w for i, w in zip(key, width, strict=True)], _Parts(keys, arrow)
                for piece in product(*(_cuts(f, f + n, w) for f, n, w in zip(first, a.shape, new, strict=True))):
                    goal = [p // w for (p, _), w in zip(piece, new, strict=True)]
                    part = a[tuple(slice(p - f, q - f) for (p, q), f in zip(piece, first, strict=True))]
                    parts.add(goal, [np.arange(p - g * w, q - g * w) for (p, q), g, w in zip(piece, goal, new, strict=True)], part.ravel())
                yield parts.batch()

    return assemble(chunks.select(*keys, "shape", "values").mapInArrow(cut, _schema(keys, kind)), {a: to[a] for a in axes}, sizes, fill, shard)


def wanted(key: Index, size: int, axis: str) -> tuple[np.ndarray, bool]:
    """The indices that a selection asks for on an axis, in its order, and whether the axis stays."""
    if isinstance(key, slice):
        start, stop, step = key.indices(size)
        if step < 1:
            raise ValueError("steps must be positive")
        return np.arange(start, stop, step), True
    one = isinstance(key, (int, np.integer))
    found = np.array([key] if one else list(key), dtype=np.int64)
    if ((found < -size) | (found >= size)).any():
        raise IndexError(f"index {key} on axis {axis} of size {size}")
    return np.where(found < 0, found + size, found), not one


def touched(chunks: DataFrame, chunk: Mapping[str, int], sizes: Mapping[str, int], **keys: Index) -> DataFrame:
    """The chunk rows that a selection touches: filters on chunk numbers, which reach the scan."""
    for axis, key in keys.items():
        indices, _ = wanted(key, sizes[axis], axis)
        numbers = np.unique(indices // chunk[axis]).tolist()
        name = F.col(f"{axis}_chunk")
        if not numbers:
            chunks = chunks.filter(F.lit(False))
        elif numbers == list(range(numbers[0], numbers[-1] + 1)):
            chunks = chunks.filter((name >= numbers[0]) & (name <= numbers[-1]))
        else:
            chunks = chunks.filter(name.isin(numbers))
    return chunks


def select(chunks: DataFrame, chunk: Mapping[str, int], sizes: Mapping[str, int], fill=0, **keys: Index) -> tuple[DataFrame, dict[str, int], dict[str, int]]:
    """Basic and orthogonal selection on chunk rows: the result's chunk rows, its chunk and its sizes.

    As ``cells.select``: an int takes one index and drops its axis, a slice keeps a range and
    renumbers it, a list keeps its indices in the order asked for, repeated ones repeatedly. Only
    chunks that hold chosen indices are read, and only chosen cells leave them.
    """
    axes = list(chunk)
    asked = {a: wanted(keys.get(a, slice(None)), sizes[a], a) for a in axes}
    stay = [a for a in axes if asked[a][1]]
    size = {a: len(asked[a][0]) for a in stay}
    if not stay:
        raise ValueError("a selection keeps an axis at least; filter cells for a single one")
    goal = {a: max(1, min(chunk[a], size[a])) for a in stay}
    keys_in, keys_out = [f"{a}_chunk" for a in axes], [f"{a}_chunk" for a in stay]
    kind, arrow = element(chunks)
    width = [chunk[a] for a in axes]
    # Where the indices of each chunk go: sorted by chunk once, looked up for each.
    table = {}
    for a, w in zip(axes, width, strict=True):
        indices = asked[a][0]
        order = np.argsort(indices // w, kind="stable")
        table[a] = (indices[order] // w, indices[order] % w, order)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = zip(*(batch.column(k).to_pylist() for k in keys_in), strict=True)
            for key, shape, values in zip(at, rows_of(batch.column("shape")), rows_of(batch.column("values")), strict=True):
                inside, places = [], []
                for a, i in zip(axes, key, strict=True):
                    number, local, place = table[a]
                    lo, hi = np.searchsorted(number, [i, i + 1])
                    inside.append(local[lo:hi])
                    places.append(place[lo:hi])
                if not all(len(x) for x in inside):
                    continue
                taken = values.reshape(shape)[np.ix_(*inside)].reshape([len(x) for x, a in zip(inside, axes, strict=True) if a in size])
                parts = _Parts(keys_out, arrow)
                kept = [x for x, a in zip(places, axes, strict=True) if a in size]
                groups = [[np.flatnonzero(x // goal[a] == g) for g in np.unique(x // goal[a])] for x, a in zip(kept, stay, strict=True)]
                for pick in product(*groups):
                    to = [int(x[p[0]]) // goal[a] for x, p, a in zip(kept, pick, stay, strict=True)]
                    parts.add(to, [x[p] - g * goal[a] for x, p, g, a in zip(kept, pick, to, stay, strict=True)], taken[np.ix_(*pick)].ravel())
                yield parts.batch()

    held = touched(chunks, chunk, sizes, **keys).select(*keys_in, "shape", "values")
    return assemble(held.mapInArrow(take, _schema(keys_out, kind)), goal, size, fill), goal, size


def with_range(chunks: DataFrame) -> DataFrame:
    """Each chunk with its least and largest value (``low``, ``high``; null where all are NaN) and how many are NaN (``nans``)."""
    real = F.col("values")
    nans = F.lit(0)
    if element(chunks)[0] in ("float", "double"):
        real = F.filter("values", lambda v: ~F.isnan(v))
        nans = F.size("values") - F.size(real)
    return chunks.withColumns({"low": F.array_min(real), "high": F.array_max(real), "nans": nans.cast("long")})


def not_empty(chunks: DataFrame) -> DataFrame:
    """Chunk rows (with their ranges) that are neither all zero nor all NaN: a filter that reaches the scan."""
    return chunks.filter((F.col("low") < 0) | (F.col("high") > 0) | ((F.col("nans") > 0) & F.col("low").isNotNull()))


def drop_empty(chunks: DataFrame, chunk: Mapping[str, int], sizes: Mapping[str, int], block: Sequence[str], channel: str) -> DataFrame:
    """Chunk rows (with their ranges) of blocks of which no channel is all zero or all NaN.

    As ``cells.drop_empty``, told by the chunks' ranges without opening one; chunks that aren't
    held are zero. A chunk holds one index of the block's axes and of the channel.
    """
    if any(chunk[a] != 1 for a in [*block, channel]):
        raise ValueError("chunks must hold one index of the block's axes and of the channel")
    rest = [a for a in chunk if a not in [*block, channel]]
    whole = int(np.prod([-(-sizes[a] // chunk[a]) for a in rest], dtype=np.int64))
    names = [f"{a}_chunk" for a in block]
    by_channel = chunks.groupBy(*names, f"{channel}_chunk").agg(
        F.max((F.col("low") != 0) | (F.col("high") != 0)).alias("other"),
        F.sum("nans").alias("nans"),
        F.max(F.col("low").isNotNull()).alias("real"),
        F.count("*").alias("n"),
    )
    # Something is neither zero nor NaN, or zeros (held or not) and NaN are mixed.
    full = F.coalesce("other", F.lit(False)) | ((F.col("nans") > 0) & (F.col("real") | (F.col("n") < whole)))
    blocks = by_channel.groupBy(*names).agg(F.count_if(full).alias("full")).filter(F.col("full") == sizes[channel])
    return chunks.join(blocks.select(*names), names, "left_semi")


def from_rows(df: DataFrame, row: str, array: str, value: Callable[[Column], Column], chunk: Mapping[str, int], sizes: Mapping[str, int], fill=0, shard: Mapping[str, int] | None = None) -> DataFrame:
    """Rows of arrays as 2-D chunk rows, cut and joined as slices: no row is made for a cell.

    ``chunk`` and ``sizes`` have the row axis first. A row that is missing or short reads as the
    fill value, of a repeated one any stays; chunks of the fill value alone aren't kept. ``value``
    turns an element into a cell.
    """
    (y, height), (x, width) = chunk.items()
    rows = df.filter(F.col(array).isNotNull() & F.col(row).between(0, sizes[y] - 1)).select(F.col(row).cast("long").alias("row"), F.slice(F.transform(array, value), 1, sizes[x]).alias("values"))
    kind, arrow = element(rows)
    keys = [f"{y}_chunk", f"{x}_chunk"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, STEP_CELLS // max(1, sizes[x]))
        for batch in (whole.slice(first, step) for whole in batches for first in range(0, whole.num_rows, step)):
            parts = _Parts(keys, arrow)
            for k, values in zip(batch.column("row").to_pylist(), rows_of(batch.column("values")), strict=True):
                for a, b in _cuts(0, len(values), width) if len(values) else ():
                    parts.add([k // height, a // width], [np.array([k % height]), np.arange(a % width, a % width + b - a)], values[a:b])
            yield parts.batch()

    return assemble(rows.mapInArrow(cut, _schema(keys, kind)), chunk, sizes, fill, shard)


def _blocks(a: np.ndarray, factors: Sequence[int]) -> np.ndarray:
    """Blocks along a last axis; sizes that aren't multiples are padded with the edge."""
    a = np.pad(a, [(0, -n % f) for n, f in zip(a.shape, factors, strict=True)], mode="edge")
    split = [x for n, f in zip(a.shape, factors, strict=True) for x in (n // f, f)]
    order = [*range(0, 2 * a.ndim, 2), *range(1, 2 * a.ndim, 2)]
    return a.reshape(split).transpose(order).reshape([*split[::2], -1])


def _mode(blocks: np.ndarray) -> np.ndarray:
    """The most frequent value of each block, the smallest of equals."""
    rows = np.sort(blocks.reshape(-1, blocks.shape[-1]), axis=1)
    n = rows.shape[1]
    new = np.ones(rows.shape, dtype=bool)
    new[:, 1:] = rows[:, 1:] != rows[:, :-1]
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0), axis=1)
    run = np.arange(n) - start  # length of the run so far: the first largest ends the smallest value's run
    return np.take_along_axis(rows, run.argmax(axis=1)[:, None], axis=1)[:, 0].reshape(blocks.shape[:-1])


def reduce_block(a: np.ndarray, factors: Sequence[int], method: str) -> np.ndarray:
    if method == "stride":
        return a[tuple(slice(None, None, f) for f in factors)]
    blocks = _blocks(a, factors)
    if method == "mode":
        return _mode(blocks)
    out = getattr(np, method)(blocks, axis=-1)
    return np.trunc(out).astype(a.dtype) if a.dtype.kind in "iu" else out.astype(a.dtype)


def _pooled_cuts(start: int, stop: int, size: int, factor: int, width: int) -> list[tuple[int, int, bool]]:
    """A chunk's range on one axis, cut into ranges of blocks that it holds whole, and halves of blocks that it shares.

    All are cut where a chunk of the next level ends too. The array's last block ends with it.
    """
    first, last = -(-start // factor) * factor, stop if stop == size else stop // factor * factor
    ends = [(start, min(first, stop), False), (first, last, True), (max(first, last), stop, False)]
    return [(a, b, whole) for p, q, whole in ends if p < q for a, b in _cuts(p, q, width * factor)]


def pool_chunks(chunks: DataFrame, chunk: Mapping[str, int], factors: Mapping[str, int], sizes: Mapping[str, int], method: str = "mean", fill=0) -> DataFrame:
    """The next level's chunk rows (of the same chunk shape), pooled chunk by chunk.

    Blocks that a chunk holds whole are reduced where they are, and only what they are reduced to
    is shuffled. Blocks over a border meet as a halo: each chunk sends the cells that it has of
    them to the chunk of the next level that they go to, where they are pooled.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    axes = list(chunk)
    step = [factors.get(a, 1) for a in axes]
    before = [sizes[a] for a in axes]
    after = {a: -(-sizes[a] // f) for a, f in zip(axes, step, strict=True)}
    width = [chunk[a] for a in axes]
    keys = [f"{a}_chunk" for a in axes]
    kind, arrow = element(chunks)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = zip(*(batch.column(k).to_pylist() for k in keys), strict=True)
            for key, shape, values in zip(at, rows_of(batch.column("shape")), rows_of(batch.column("values")), strict=True):
                a, first, parts, halo = values.reshape(shape), [i * w for i, w in zip(key, width, strict=True)], _Parts(keys, arrow), []
                cuts = [_pooled_cuts(f, f + n, size, by, w) for f, n, size, by, w in zip(first, a.shape, before, step, width, strict=True)]
                for piece in product(*cuts):
                    part = a[tuple(slice(p - f, q - f) for (p, q, _), f in zip(piece, first, strict=True))]
                    goal = [p // (w * by) for (p, _, _), w, by in zip(piece, width, step, strict=True)]
                    whole = all(w for _, _, w in piece)
                    if whole:
                        part = reduce_block(part, step, method)
                        begin = [p // by - g * w for (p, _, _), g, w, by in zip(piece, goal, width, step, strict=True)]
                    else:
                        begin = [p - g * w * by for (p, _, _), g, w, by in zip(piece, goal, width, step, strict=True)]
                    parts.add(goal, [np.arange(b, b + n) for b, n in zip(begin, part.shape, strict=True)], part.ravel())
                    halo.append(not whole)
                yield parts.batch(("halo", pa.array(halo)))

    names = [*keys, "shape", "values"]

    def join(key: tuple, table: pa.Table) -> pa.Table:
        at = [k.as_py() for k in key]
        shape = extents(at, width, list(after.values()))
        shared = np.asarray(table["halo"].combine_chunks().to_numpy(zero_copy_only=False))
        out = None
        for halo in (True, False) if shared.any() else (False,):
            own = table.filter(pa.array(shared == halo))
            if halo:
                # The cells below this chunk; blocks without one in the halo are written over or filled.
                cells = [min(n * by, size - i * w * by) for n, by, size, i, w in zip(shape, step, before, at, width, strict=True)]
                below, there = np.full(cells, fill, dtype=rows_of(own["values"])[0].dtype), np.zeros(cells, dtype=bool)
                for places, values in _given(own):
                    _put(below, places, values)
                    _put(there, places, np.ones(len(values), dtype=bool))
                out = np.where(reduce_block(there, step, "max"), reduce_block(below, step, method), np.asarray(fill, dtype=below.dtype))
                continue
            for places, values in _given(own):
                if out is None:
                    out = np.full(shape, fill, dtype=values.dtype)
                _put(out, places, values)
        made = [] if _all_fill(out, fill) else [out]
        return pa.table([*(pa.array([k] * len(made), pa.int64()) for k in at), lists([np.array(a.shape) for a in made], pa.int32()), lists(made, arrow)], names)

    parts = chunks.select(*keys, "shape", "values").mapInArrow(reduce, _schema(keys, kind) + ", halo boolean")
    made = parts.groupBy(*keys).applyInArrow(join, ", ".join(f"{k} long" for k in keys) + f", shape array<int>, values array<{kind}>")
    return made.select(*keys, shard_name(keys, chunk).alias("shard"), "shape", "values")


def pyramid(chunks: DataFrame, chunk: Mapping[str, int], axes: Sequence[str], sizes: Mapping[str, int], levels: int, method: str = "mean", keep: Callable[[int, DataFrame], DataFrame] | None = None, fill=0) -> list[DataFrame]:
    """The chunk rows of all levels, each pooled from the one before by two on ``axes``.

    ``keep`` writes a level and returns what was written, so that the next level reads it and
    nothing is made twice.
    """
    out, size = [chunks if keep is None else keep(0, chunks)], dict(sizes)
    for level in range(1, levels):
        made = pool_chunks(out[-1], chunk, {a: 2 for a in axes}, size, method, fill)
        size = {a: -(-n // 2) if a in axes else n for a, n in size.items()}
        out.append(made if keep is None else keep(level, made))
    return out


def map_chunks(chunks: DataFrame, func: Callable[[np.ndarray], np.ndarray], chosen: Mapping[str, Sequence[int]] | None = None, done: DataFrame | None = None) -> DataFrame:
    """Call ``func`` on every chunk that is held; it returns an array of the same shape.

    ``chosen`` names the chunk numbers to take on some axes, which reach the scan as filters;
    ``done`` holds the chunks that are complete (``<axis>_chunk``) and aren't handed over again.
    """
    for axis, numbers in (chosen or {}).items():
        chunks = chunks.filter(F.col(f"{axis}_chunk").isin(list(numbers)))
    if done is not None:
        chunks = chunks.join(done, [c for c in done.columns if c.endswith("_chunk")], "left_anti").select(*chunks.columns)
    kind = chunks.schema["values"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(values=[np.asarray(func(np.asarray(v).reshape(tuple(s)))).ravel() for s, v in zip(pdf["shape"], pdf["values"], strict=True)])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString() if f.name != 'values' else kind}" for f in chunks.schema.fields)
    return chunks.mapInPandas(run, fields)
