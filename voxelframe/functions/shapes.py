"""Shapes, chunks and shards as expressions on arrays of sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Axis order of images.
AXES = ("T", "C", "Z", "Y", "X")
# The default chunk of the newer format, and the byte limit of a chunk in the older.
DEFAULT_CHUNK = (1, 1, 16, 256, 256)
MAX_CHUNK_BYTES = 500_000_000


def pad_shape(shape: Column, n: int) -> Column:
    """Ones on the left up to ``n`` axes."""
    return F.concat(F.array_repeat(F.lit(1).cast("long"), F.greatest(F.lit(n) - F.size(shape), F.lit(0))), shape)


def missing_axes(names: Column) -> Column:
    """Image axes that none of the axis names begins with, in image order."""
    return F.array_except(F.array(*[F.lit(a) for a in AXES]), F.transform(names, lambda a: F.upper(F.substr(a, F.lit(1), F.lit(1)))))


def ceil_div(n: Column, by: Column | int) -> Column:
    return F.ceil(n / by).cast("long")


def n_bytes(shape: Column, item: Column) -> Column:
    return F.aggregate(shape, F.lit(1).cast("long"), lambda a, x: a * x) * item


def clamp(chunks: Column, shape: Column) -> Column:
    return F.zip_with(chunks, shape, lambda c, n: F.least(c, n))


def _halved(z: Column, plane: Column, most: int) -> Column:
    """Z halved (rounding up) until it is 1 or ``z * plane`` is at most ``most``.

    k halvings make ceil(z / 2^k), which is at most m where 2^k is at least ceil(z / m): k is the
    number of binary digits of that quotient less one. So it is said in one step, not in a loop.
    """
    fitting = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(most) / plane))
    beyond = F.ceil(z / fitting) - 1
    k = F.when(beyond > 0, F.length(F.bin(beyond))).otherwise(0)
    return F.when((plane > 0) & (z > 1), F.ceil(z / F.pow(F.lit(2.0), k)).cast("long")).otherwise(z)


def limited_chunk(shape: Column, item: Column, most: int = MAX_CHUNK_BYTES) -> Column:
    """The older format's default chunk: one volume, Z halved (rounding up) until it fits ``most`` bytes."""
    plane = F.try_element_at(shape, F.lit(4)) * F.try_element_at(shape, F.lit(5)) * item
    z = _halved(F.try_element_at(shape, F.lit(3)), plane, most)
    one = F.lit(1).cast("long")
    return F.array(one, one, z.cast("long"), F.try_element_at(shape, F.lit(4)), F.try_element_at(shape, F.lit(5)))


def default_chunk(shape: Column) -> Column:
    """The newer format's default chunk."""
    return clamp(F.array(*[F.lit(c).cast("long") for c in DEFAULT_CHUNK]), shape)


def default_shards(shape: Column, chunks: Column) -> Column:
    """Chunks in a shard of one volume."""
    ratio = F.zip_with(shape, chunks, lambda n, c: F.ceil(n / c).cast("long"))
    return F.concat(F.array_repeat(F.lit(1).cast("long"), 2), F.slice(ratio, 3, 3))


def chosen_chunk(sizes: Column, shape: Column, item: Column, most: int = MAX_CHUNK_BYTES) -> Column:
    """struct(chunk, clamped) of a conversion asked for by sizes: Z halved until it fits the byte limit, all cut to the shape.

    ``clamped`` lists the axes on which the chunk is smaller than asked for, to be warned of. Other
    numbers of sizes than five raise.
    """
    refused = F.raise_error(F.concat(F.lit("chunks need five sizes: "), F.to_json(sizes))).cast("array<bigint>")
    own = F.when(F.size(sizes) == 5, sizes.cast("array<bigint>")).otherwise(refused)
    asked, there = ([F.try_element_at(c, F.lit(k)) for k in range(1, 6)] for c in (own, shape))
    cut = [*asked[:2], _halved(asked[2], asked[3] * asked[4] * item, most), *asked[3:]]
    cut = [F.least(c, n) for c, n in zip(cut, there, strict=True)]
    more = F.slice(shape, 6, F.greatest(F.size(shape) - 5, F.lit(0)))  # axes beyond the five are taken whole
    limited = F.when(shape.isNotNull(), F.concat(F.array(*cut), more))
    smaller = F.array_compact(F.array(*[F.when(shape.isNotNull() & (c < a), F.lit(k)) for k, (c, a) in enumerate(zip(cut, asked, strict=True))]))
    return F.struct(limited.alias("chunk"), smaller.alias("clamped"))


def requested_chunk(request: Column, shape: Column, item: Column) -> Column:
    """Chunks of a conversion: ``XY`` one plane, ``XYZ`` or nothing one volume within the byte limit; null for others."""
    volume = limited_chunk(shape, item)
    plane = F.concat(F.array_repeat(F.lit(1).cast("long"), 3), F.slice(shape, 4, 2))
    name = F.upper(F.coalesce(request, F.lit("")))
    return F.when(name == "XY", plane).when(name.isin("XYZ", ""), clamp(volume, shape))


def slice_indices(start: Column, stop: Column, step: int = 1) -> Column:
    return F.when(stop > start, F.sequence(start, stop - 1, F.lit(step).cast("long"))).otherwise(F.array().cast("array<long>"))


def parse_dims(text: Column) -> Column:
    """A list of axis letters like ``"z, Y"`` in small letters; null if one is no image axis."""
    parts = F.transform(F.split(text, ","), lambda p: F.lower(F.trim(p)))
    fine = F.size(F.array_except(parts, F.array(*[F.lit(a.lower()) for a in AXES]))) == 0
    return F.when(fine, parts)


def flat_index(indices: list[Column], sizes: list[int]) -> Column:
    """Row-major position of an index."""
    out = F.lit(0).cast("long")
    for i, n in zip(indices, sizes, strict=True):
        out = out * n + i
    return out


def axis_index(axes: Column, asked: Column) -> Column:
    """The place of an axis in a list, whatever its case; one that isn't there raises."""
    at = F.array_position(F.transform(axes, F.lower), F.lower(asked))
    return F.when(at > 0, at - 1).otherwise(F.raise_error(F.concat(F.lit("no such axis: "), asked)).cast("long"))


def as_indices(one: Column, listed: Column, start: Column, stop: Column, step: int = 1) -> Column:
    """The indices that a request names: one number, else a list as it is, else a range."""
    return F.coalesce(F.when(one.isNotNull(), F.array(one.cast("long"))), listed.cast("array<bigint>"), slice_indices(start.cast("long"), stop.cast("long"), step))


def shape_mismatch(shape: Column, wanted: Column) -> Column:
    """Whether data of a shape doesn't fit an array; a rank that differs never does."""
    return (F.size(shape) != F.size(wanted)) | F.exists(F.arrays_zip(shape.alias("a"), wanted.alias("b")), lambda p: ~p["a"].eqNullSafe(p["b"]))
