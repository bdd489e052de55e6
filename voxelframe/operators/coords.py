"""Physical coordinates: scales, translations and labelled axes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Units that axes may have.
SPACE_UNITS = (
    "angstrom", "attometer", "centimeter", "decimeter", "exameter", "femtometer", "foot", "gigameter",
    "hectometer", "inch", "kilometer", "megameter", "meter", "micrometer", "mile", "millimeter",
    "nanometer", "parsec", "petameter", "picometer", "terameter", "yard", "yoctometer", "yottameter",
    "zeptometer", "zettameter",
)
TIME_UNITS = (
    "attosecond", "centisecond", "day", "decisecond", "exasecond", "femtosecond", "gigasecond", "hectosecond",
    "hour", "kilosecond", "megasecond", "microsecond", "millisecond", "minute", "nanosecond", "petasecond",
    "picosecond", "second", "terasecond", "yoctosecond", "yottasecond", "zeptosecond", "zettasecond",
)


def valid_unit(kind: Column, unit: Column) -> Column:
    """Whether an axis of a kind may have a unit: space and time have their own, others any; none is always fine."""
    return unit.isNull() | F.when(kind == "space", unit.isin(*SPACE_UNITS)).when(kind == "time", unit.isin(*TIME_UNITS)).otherwise(F.lit(True))


def coordinates(n: Column, scale: Column, translation: Column) -> Column:
    """The coordinate of each of ``n`` indices."""
    plain = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: i * scale + translation)
    return F.when(n > 0, plain).otherwise(F.array().cast("array<double>"))


def coordinate(index: Column, scale: Column, translation: Column) -> Column:
    return index * scale + translation


def index_of(coordinate: Column, scale: Column, translation: Column) -> Column:
    """The nearest index, halves to the even one."""
    return F.rint((coordinate - translation) / scale).cast("long")


def infer_scale(coordinates: Column) -> Column:
    """The step between the first two coordinates; 1 for fewer than two."""
    return F.coalesce(F.try_element_at(coordinates, F.lit(2)) - F.try_element_at(coordinates, F.lit(1)), F.lit(1.0))


def effective(transforms: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and axis, the product of all scales and the sum of all translations.

    ``transforms``: keys, type (scale, translation or identity), values array. Axes without a
    scale have 1, without a translation 0.
    """
    flat = transforms.select(*keys, "type", F.posexplode("values").alias("axis", "v"))
    # Products of positive and negative factors alike, as Spark's product() has them.
    return flat.groupBy(*keys, "axis").agg(
        F.coalesce(F.product(F.when(F.col("type") == "scale", F.col("v"))), F.lit(1.0)).alias("scale"),
        F.coalesce(F.sum(F.when(F.col("type") == "translation", F.col("v"))), F.lit(0.0)).alias("translation"),
    )


def set_scale(images: DataFrame, axis: int, value: float, where: Column) -> DataFrame:
    """Set one axis of the ``scale`` array of some images; the old one is added to ``history``."""
    if value <= 0:
        raise ValueError("a scale must be positive")
    changed = F.transform("scale", lambda v, i: F.when(i == axis, F.lit(value)).otherwise(v))
    return images.withColumn("history", F.when(where, F.concat("history", F.array("scale"))).otherwise(F.col("history"))).withColumn("scale", F.when(where, changed).otherwise(F.col("scale")))


def with_coordinates(cells: DataFrame, scales: dict[str, tuple[float, float]]) -> DataFrame:
    """Add ``<axis>_coord`` to cells: arithmetic on the index, not a join."""
    for axis, (scale, translation) in scales.items():
        cells = cells.withColumn(f"{axis}_coord", coordinate(F.col(axis), F.lit(scale), F.lit(translation)))
    return cells


def with_axes(cells: DataFrame, axes: dict[str, dict], attributes: dict | None = None) -> DataFrame:
    """Cells whose axes carry what is known of them (``kind``, ``unit``, ``scale``, ``translation``), and ``value`` the array's attributes.

    They are the columns' metadata, so they stay through selections and are written and read with
    the table. A unit that isn't one of the axis's kind raises.
    """
    for axis, about in axes.items():
        unit, kind = about.get("unit"), about.get("kind", "space")
        if unit is not None and ((kind == "space" and unit not in SPACE_UNITS) or (kind == "time" and unit not in TIME_UNITS)):
            raise ValueError(f"{unit!r} is no unit of {kind}")
        own = {"kind": kind, "unit": unit, "scale": float(about.get("scale", 1.0)), "translation": float(about.get("translation", 0.0))}
        cells = cells.withMetadata(axis, {"axis": {k: v for k, v in own.items() if v is not None}})
    return cells.withMetadata("value", {"attributes": json.dumps(attributes)}) if attributes is not None else cells


def axes_of(cells: DataFrame) -> tuple[dict[str, dict], dict]:
    """What a table's columns carry: each axis's kind, unit, scale and translation, and the array's attributes."""
    found = {f.name: {"unit": None} | f.metadata["axis"] for f in cells.schema.fields if "axis" in f.metadata}
    about = next((f.metadata["attributes"] for f in cells.schema.fields if f.name == "value" and "attributes" in f.metadata), "{}")
    return found, json.loads(about)


def labelled(cells: DataFrame) -> DataFrame:
    """Cells with the coordinates that their axes' metadata give."""
    return with_coordinates(cells, {a: (x["scale"], x["translation"]) for a, x in axes_of(cells)[0].items()})


def coordinate_blocks(n: Column, block: int = 10_000) -> Column:
    """Numbers of the blocks of at most ``block`` indices that ``n`` indices make: no row holds an axis whole."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / block))).otherwise(F.array().cast("array<bigint>"))


def exploded(df: DataFrame, n: str, scale: Column, translation: Column, block: int = 10_000) -> DataFrame:
    """A row for each of the ``n`` indices of each row, with ``i`` and ``coord``; ``n`` is dropped."""
    first = F.col("__block") * block
    parts = df.withColumn("__block", F.explode(coordinate_blocks(F.col(n), block)))
    rows = parts.withColumn("i", F.explode(F.sequence(first, F.least(first + block, F.col(n)) - 1)))
    return rows.withColumn("coord", coordinate(F.col("i"), scale, translation)).drop("__block", n)


def write_labelled(cells: DataFrame, data: DataFrame, axes: list[str], scales: dict[str, tuple[float, float]], names: dict[str, DataFrame] | None = None) -> DataFrame:
    """Upsert cells given by coordinate: new values replace old ones at the nearest index.

    ``data`` has ``<axis>_coord`` for the axes of ``scales`` (scale, translation), ``<axis>_name``
    for those of ``names`` (tables of name and index) and plain indices for the others. A name
    that an axis doesn't have raises when it is read.
    """
    for axis, (scale, translation) in scales.items():
        data = data.withColumn(axis, index_of(F.col(f"{axis}_coord"), F.lit(scale), F.lit(translation)))
    for axis, known in (names or {}).items():
        own = known.select(F.col("name").alias(f"{axis}_name"), F.col("index").cast("long").alias(axis))
        absent = F.raise_error(F.concat(F.lit(f"no such {axis}: "), F.col(f"{axis}_name"))).cast("long")
        data = data.join(own, f"{axis}_name", "left").withColumn(axis, F.coalesce(F.col(axis), absent))
    moved = data.select(*axes, "value")
    return cells.join(moved, axes, "left_anti").select(*axes, "value").unionByName(moved)


def replace_transforms(transforms: DataFrame, image: str, new: list[tuple[str, list[float]]]) -> DataFrame:
    """Transforms (image, ordinal, type, values) with those of one image, or of all (``*``), replaced by ``new`` (type, values)."""
    chosen = F.lit(image == "*") | (F.col("image") == image)
    listed = F.array(*[F.struct(F.lit(k).cast("long").alias("ordinal"), F.lit(t).alias("type"), F.lit([float(x) for x in v]).alias("values")) for k, (t, v) in enumerate(new)])
    put = transforms.filter(chosen).select("image").distinct().select("image", F.inline(listed))
    return transforms.filter(~chosen).select("image", "ordinal", "type", "values").unionByName(put)
