"""Stores' metadata files as tables: a registered reader, and what a store's layout and version are.

``spark.read.format("ngff_metadata").load(path)`` gives a row for each group or array below
``path`` that has a metadata file: its path, depth, metadata version of storage, and JSON
attributes. Partitions are the store's groups at one depth, so that walking a large store is many
tasks' work; the options ``under`` and ``deepest`` cut the walk short instead of dropping rows.
They are options and not pushed filters, as Spark has one reader for all scans of a loaded table:
what is pushed for one side of a self-join would narrow the other side too.
Files are reached through Arrow's file systems, so a path may be a local one or a URI.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from voxelframe.functions.names import natural_key
from voxelframe.operators import hierarchy as H

FORMAT = "ngff_metadata"
SCHEMA = "path string, depth int, kind string, format int, attributes string, problem string"
# Metadata files of the newer storage format, and of the older one.
NEWER, OLDER = "zarr.json", (".zgroup", ".zarray", ".zattrs")
LAYOUTS = ("fov", "hcs", "bf2raw", "tiled")
#: Depth of the groups that one partition each is made of.
SPLIT = 1
#: Arrays hold chunks, not nodes, so a walk doesn't enter them.
DEEPEST = 64


class _Walk(InputPartition):
    def __init__(self, path: str, below: bool):
        self.path, self.below = path, below


def _open(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root.rstrip("/"))


class MetadataReader(DataSourceReader):
    """Walks groups from the root down, as far as it is asked to."""

    def __init__(self, root: str, split: int = SPLIT, under: str = "", deepest: int = DEEPEST):
        self.root, self.split, self.under, self.deepest = root, split, under.strip("/"), deepest

    def _wanted(self, path: str) -> bool:
        return not self.under or path == self.under or path.startswith(self.under + "/")

    def _on_the_way(self, path: str) -> bool:
        """Whether wanted paths may lie at or below ``path``."""
        return self._wanted(path) or not path or self.under.startswith(path + "/")

    def partitions(self) -> list[InputPartition]:
        files, root = _open(self.root)
        out, level = [], [""]
        for depth in range(min(self.split, self.deepest) + 1):
            last = depth == min(self.split, self.deepest)
            out += [_Walk(p, last) for p in level]
            level = [] if last else [c for p in level for c in self._children(files, root, p)]
        return out

    def _children(self, files, root: str, path: str) -> list[str]:
        from pyarrow import fs

        node = self._node(files, root, path)
        if node is not None and node[2] == "array":
            return []
        found = files.get_file_info(fs.FileSelector(f"{root}/{path}" if path else root, allow_not_found=True))
        names = sorted(f.base_name for f in found if f.type == fs.FileType.Directory and not f.base_name.startswith("."))
        return [c for c in (f"{path}/{n}" if path else n for n in names) if self._on_the_way(c)]

    def _node(self, files, root: str, path: str) -> tuple | None:
        """The row of one folder; null where it has no metadata file. A broken file is a row with its problem."""
        at = f"{root}/{path}" if path else root
        depth = path.count("/") + 1 if path else 0

        def text(name: str) -> str | None:
            try:
                with files.open_input_stream(f"{at}/{name}") as f:
                    return f.read().decode()
            except (FileNotFoundError, NotADirectoryError):
                return None

        try:
            if (newer := text(NEWER)) is not None:
                meta = json.loads(newer)
                return path, depth, meta.get("node_type"), meta.get("zarr_format"), json.dumps(meta.get("attributes") or {}), None
            group, array, more = map(text, OLDER)
            if group is None and array is None:
                return None
            meta = json.loads(array if array is not None else group)
            return path, depth, "array" if array is not None else "group", meta.get("zarr_format"), json.dumps(json.loads(more) if more else {}), None
        except (ValueError, AttributeError) as e:
            return path, depth, None, None, None, str(e)

    def read(self, partition: _Walk) -> Iterator[tuple]:
        files, root = _open(self.root)
        left = [partition.path]
        while left:
            path = left.pop()
            if self._wanted(path) and (node := self._node(files, root, path)) is not None:
                yield node
            depth = path.count("/") + 1 if path else 0
            if partition.below and depth < self.deepest:
                left += self._children(files, root, path)[::-1]


class MetadataSource(DataSource):
    """Options: ``split``, the depth of the groups that are a partition each; ``under``, a node to read with all below it; ``deepest``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MetadataReader:
        asked = self.options
        return MetadataReader(asked["path"], int(asked.get("split", SPLIT)), asked.get("under", ""), int(asked.get("deepest", DEEPEST)))


def nodes(spark: SparkSession, path: str, under: str = "", deepest: int = DEEPEST, split: int = SPLIT) -> DataFrame:
    """The metadata of all groups and arrays of a store, or of a node and what is below it, down to a depth."""
    spark.dataSource.register(MetadataSource)
    return spark.read.format(FORMAT).options(split=split, under=under, deepest=deepest).load(path)


def own_version(attributes: Column) -> Column:
    """The version that a group's own attributes (JSON) tell: of its plate, well or wrapper, else of its first image that has one."""
    told = [F.nullif(F.get_json_object(attributes, f"$.{k}.version"), F.lit("")) for k in ("plate", "well", "ome")]
    images = F.from_json(F.get_json_object(attributes, "$.multiscales"), "array<struct<version:string>>")
    first = F.try_element_at(F.filter(F.transform(images, lambda m: m["version"]), lambda v: v.isNotNull() & (v != "")), F.lit(1))
    return F.coalesce(*told, first)


def is_series(attributes: Column) -> Column:
    """Whether a group is marked as a numbered series, in flat or wrapped attributes."""
    keys = F.json_object_keys(attributes)
    wrapped = F.json_object_keys(F.get_json_object(attributes, "$.ome"))
    marker = "bioformats2raw.layout"
    return F.coalesce(F.array_contains(keys, marker), F.lit(False)) | F.coalesce(F.array_contains(wrapped, marker), F.lit(False))


def versions(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, version) of each store, as its metadata tell it from the root down.

    The root's own version; else, for a series, that of its first child (but ``OME``) that has
    one, or else that of its storage format; else that of the first well, rows and wells in
    natural order; else ``unknown``. Stores whose root can't be read have null.
    """
    own = nodes.filter("depth <= 2").withColumns({"__v": own_version(F.col("attributes")), "__order": F.transform(F.split("path", "/"), natural_key), "__series": is_series(F.col("attributes"))})
    root, named = F.col("depth") == 0, F.col("__v").isNotNull()
    at = lambda where, pick: F.min(F.when(where & named, F.struct("__order", pick.alias("v"))))["v"]
    one = own.groupBy(*keys).agg(
        F.max(F.when(root, F.col("__v"))).alias("root"),
        F.max(root & F.col("__series")).alias("series"),
        F.max(F.when(root, F.col("format"))).alias("format"),
        F.max(root & F.col("attributes").isNotNull()).alias("readable"),
        at((F.col("depth") == 1) & (F.col("path") != "OME"), F.col("__v")).alias("child"),
        at(F.col("depth") == 2, F.col("__v")).alias("well"),
    )
    by_format = F.when(F.col("format") == 3, "0.5").otherwise("0.4")
    below = F.when(F.col("series"), F.coalesce("child", by_format)).otherwise(F.coalesce("well", F.lit("unknown")))
    return one.select(*keys, F.when(F.col("readable"), F.coalesce("root", below)).alias("version"))


def open_store(spark: SparkSession, path: str, layout: str = "auto") -> tuple[str, str, DataFrame]:
    """Layout, version and nodes of a store that is there; a layout asked for must be what the metadata say.

    A tiled image can't be told from a plain one, so it has to be asked for.
    """
    found = nodes(spark, path)
    root = nodes(spark, path, deepest=0).select("attributes", "problem").first()
    if root is None or root["attributes"] is None:
        raise FileNotFoundError(f"no store at {path}" if root is None else f"{path}: {root['problem']}")
    flat = json.loads(root["attributes"])
    keys = flat.get("ome", flat)
    is_there = {"hcs": "plate" in keys, "bf2raw": "bioformats2raw.layout" in keys, "fov": "multiscales" in keys, "tiled": "multiscales" in keys}
    if layout == "auto":
        layout = next((k for k in ("hcs", "bf2raw", "fov") if is_there[k]), None)
        if layout is None:
            raise KeyError(f"{path} has the metadata of no known layout")
    elif layout not in LAYOUTS:
        raise ValueError(f"unknown layout {layout!r}")
    elif not is_there[layout]:
        raise ValueError(f"layout {layout!r} isn't that of the metadata of {path}")
    version = keys.get("version", "0.5") if "ome" in flat else "0.4"
    return layout, version, found


def layout_of(attributes: Column) -> Column:
    """Layout of a root group's attributes (JSON), wrapped or flat; none of the known ones raises."""
    keys = F.coalesce(F.json_object_keys(F.get_json_object(attributes, "$.ome")), F.json_object_keys(attributes))
    refused = F.raise_error(F.concat(F.lit("the metadata of no known layout: "), attributes)).cast("string")
    return F.coalesce(H.layout(keys), refused)
