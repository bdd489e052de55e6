"""Command line over stored arrays: info, convert, compute-pyramid, set-scale, rename-wells.

A store is a folder: ``level=<k>`` folders of chunk rows, and ``image.json`` with the sizes,
chunk, scale and history of scales.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from voxelframe.operators import chunks, hierarchy
from voxelframe.sources import arrays


def read_meta(spark: SparkSession, store: str) -> dict:
    return json.loads(spark.read.option("wholetext", True).text(f"{store}/image.json").first()[0])


def write_meta(spark: SparkSession, store: str, meta: dict) -> None:
    """One small text file, through the store's own file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{store}/image.json")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(json.dumps(meta).encode()))
    out.close()


def expand(spark: SparkSession, paths: list[str]) -> list[str]:
    """The stores that paths name: a store itself, or for a plate all its positions (row/column/field), in natural order.

    A path that is neither raises.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    out = []
    for path in paths:
        path = path.rstrip("/")
        files = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if files.exists(hadoop.Path(f"{path}/image.json")):
            out.append(path)
            continue
        found = [f.getPath().getParent().toString() for f in files.globStatus(hadoop.Path(f"{path}/*/*/*/image.json")) or []]
        if not found:
            raise FileNotFoundError(f"{path} is neither a store nor a plate of stores")
        natural = lambda p: [(x.isdigit(), int(x) if x.isdigit() else 0, x) for x in p.split("/")[-3:]]
        out += sorted(found, key=natural)
    return out


def info(spark: SparkSession, store: str) -> str:
    meta = read_meta(spark, store)
    lines = [f"{store}: {len(meta['levels'])} level(s), chunk {meta['chunk']}, scale {meta['scale']}"]
    for k, sizes in enumerate(meta["levels"]):
        n = spark.read.parquet(f"{store}/level={k}").count()
        lines.append(f"  level {k}: " + " x ".join(f"{a} {s}" for a, s in sizes.items()) + f", {n} chunks held")
    return "\n".join(lines)


def convert(spark: SparkSession, source: str, store: str, row: str, array: str, chunk: dict[str, int]) -> None:
    """A Parquet table with one array per row becomes a store of one level."""
    rows = spark.read.parquet(source)
    top = rows.agg(F.coalesce(F.max(row) + 1, F.lit(0)), F.coalesce(F.max(F.size(array)), F.lit(0))).first()
    sizes = {"y": int(top[0]), "x": max(0, int(top[1]))}
    chunk = {a: min(chunk.get(a, 256), max(1, n)) for a, n in sizes.items()}
    arrays.write(chunks.from_rows(rows, row, array, lambda v: v, chunk, sizes), f"{store}/level=0")
    write_meta(spark, store, {"levels": [sizes], "chunk": chunk, "scale": {a: 1.0 for a in sizes}, "history": []})


def compute_pyramid(spark: SparkSession, store: str, levels: int, method: str = "mean", dims: str = "y,x") -> None:
    """Levels after the first, each pooled from the stored one before it; old ones are replaced."""
    meta = read_meta(spark, store)
    sizes = [meta["levels"][0]]
    axes = [d.strip().lower() for d in dims.split(",")]
    if unknown := [a for a in axes if a not in sizes[0]]:
        raise ValueError(f"no such axes: {unknown}")
    for k in range(1, levels):
        made = chunks.pool_chunks(spark.read.parquet(f"{store}/level={k - 1}"), meta["chunk"], {a: 2 for a in axes}, sizes[-1], method)
        sizes.append({a: -(-n // 2) if a in axes else n for a, n in sizes[-1].items()})
        arrays.write(made, f"{store}/level={k}", mode="w")
    write_meta(spark, store, meta | {"levels": sizes})


def set_scale(spark: SparkSession, store: str, axis: str, value: float) -> None:
    meta = read_meta(spark, store)
    if axis not in meta["scale"] or value <= 0:
        raise ValueError(f"can't set the scale of {axis!r} to {value}")
    write_meta(spark, store, meta | {"scale": meta["scale"] | {axis: value}, "history": [*meta["history"], meta["scale"]]})


def rename_wells(spark: SparkSession, wells: str, mapping: str, out: str) -> None:
    """``wells``: Parquet with ``path``; ``mapping``: CSV of old,new; the renamed table goes to ``out``."""
    names = spark.read.csv(mapping, schema="old string, new string")
    hierarchy.rename_wells(spark.read.parquet(wells), names.select(F.trim("old").alias("old"), F.trim("new").alias("new"))).write.parquet(out)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="voxelframe", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, options in {
        "info": ["stores+"],
        "convert": ["source", "store", "--row=vec_id", "--array=embedding", "--chunk=256,64"],
        "compute-pyramid": ["stores+", "--levels=3", "--method=mean", "--dims=y,x"],
        "set-scale": ["stores+", "--axis=y", "--value=1.0"],
        "rename-wells": ["wells", "mapping", "out"],
    }.items():
        command = commands.add_parser(name)
        for o in options:
            if o.startswith("--"):
                command.add_argument(o.partition("=")[0], default=o.partition("=")[2])
            else:
                command.add_argument(o.rstrip("+"), nargs="+" if o.endswith("+") else None)
    given = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("voxelframe").getOrCreate()
    if given.command == "convert":
        y, x = map(int, given.chunk.split(","))
        convert(spark, given.source, given.store, given.row, given.array, {"y": y, "x": x})
    elif given.command == "rename-wells":
        rename_wells(spark, given.wells, given.mapping, given.out)
    for store in expand(spark, getattr(given, "stores", [])):
        if given.command == "info":
            print(info(spark, store))
        elif given.command == "compute-pyramid":
            compute_pyramid(spark, store, int(given.levels), given.method, given.dims)
        else:
            set_scale(spark, store, given.axis, float(given.value))


if __name__ == "__main__":
    main()
