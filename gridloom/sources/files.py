"""Point files and stored maps."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.params import MapParams

# Field names that stand for a column, in the order of preference.
TIME_NAMES = ("gps_time", "gpstime", "internal_time", "internaltime", "offset_time", "offsettime", "timestamp", "time")
RETURN_NAMES = ("returnnumber", "return_number", "returnnum", "return_num")
ALIASES = {"ts": TIME_NAMES, "return_number": RETURN_NAMES, "nx": ("nx", "normal_x"), "ny": ("ny", "normal_y"), "nz": ("nz", "normal_z"), "r": ("r", "red"), "g": ("g", "green"), "b": ("b", "blue"), "a": ("a", "alpha")}


def column_of(name: str) -> str:
    """The engine's name of a file's field."""
    lower = name.lower()
    return next((own for own, names in ALIASES.items() if lower in names), lower)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Dispatch by extension: ply, xyz, txt (trajectory), else Parquet."""
    kind = path.rpartition(".")[2].lower()
    return {"ply": read_ply, "xyz": read_xyz, "txt": read_trajectory}.get(kind, lambda s, p: s.read.parquet(p))(spark, path)


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """Text with a heading row: ts, x, y, z of each line with numbers for all four."""
    lines = spark.read.text(path).withColumn("parts", F.split(F.trim("value"), r"[\s,]+"))
    heading = lines.where(F.col("value").rlike("[A-DF-Za-df-z]")).select("parts").head()
    if heading is None:
        raise ValueError("an xyz file needs a heading row")
    names = [column_of(n) for n in heading[0]]
    if not {"ts", "x", "y", "z"} <= set(names):
        raise ValueError("time and position are needed")
    out = lines.select(*[F.expr(f"try_cast(get(parts, {names.index(c)}) AS DOUBLE)").alias(c) for c in ("ts", "x", "y", "z")])
    return out.where("ts IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")


def read_trajectory(spark: SparkSession, path: str) -> DataFrame:
    """Text lines `time x y z ...`; a heading or any other line without four numbers is left out."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"[\s,]+").alias("parts"))
    out = parts.select(*[F.expr(f"try_cast(get(parts, {i}) AS DOUBLE)").alias(c) for i, c in enumerate(("ts", "x", "y", "z"))])
    return out.where("ts IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")


_KINDS = {"char": "i1", "uchar": "u1", "int8": "i1", "uint8": "u1", "short": "i2", "ushort": "u2", "int16": "i2", "uint16": "u2", "int": "i4", "uint": "u4", "int32": "i4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """Vertices of PLY files (ascii or binary), one task a file; all properties as doubles."""
    files = spark.read.format("binaryFile").load(path).select("content")
    start = files.select(F.substring("content", 1, 65536).alias("c")).head()[0]
    _, fields, _, _ = ply_header(bytes(start))
    names = [column_of(n) for n, _ in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                form, own, count, at = ply_header(content)
                if form == "ascii":
                    rows = np.array([[float(v) for v in line.split()[: len(own)]] for line in content[at:].decode().splitlines()[:count]]).reshape(count, len(own))
                    columns = [rows[:, i] for i in range(len(own))]
                else:
                    table = np.frombuffer(content, np.dtype([(n, ("<" if "little" in form else ">") + k) for n, k in own]), count, at)
                    columns = [table[n].astype(float) for n, _ in own]
                by_name = dict(zip([column_of(n) for n, _ in own], columns, strict=True))
                for i in range(0, count, 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(by_name[n][i : i + 100_000]) for n in names], names=names)

    return files.mapInArrow(run, ", ".join(f"{n} double" for n in names))


def ply_header(content: bytes) -> tuple[str, list[tuple[str, str]], int, int]:
    """Format, vertex properties, vertex count and where the data begins."""
    end = content.index(b"end_header")
    at = content.index(b"\n", end) + 1
    form, fields, count, inside = "", [], 0, False
    for line in content[:end].decode("ascii", "replace").splitlines():
        word = line.split()
        if word[:1] == ["format"]:
            form = word[1]
        elif word[:1] == ["element"]:
            inside = word[1] == "vertex"
            count = int(word[2]) if inside else count
        elif word[:1] == ["property"] and inside:
            fields.append((word[-1], _KINDS[word[1]]))
    return form, fields, count, at


def write_ply(points: DataFrame, folder: str, columns: tuple[str, ...] = ("x", "y", "z")) -> int:
    """Binary PLY parts in a folder on a file system all executors share, one a partition; returns the number of vertices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import uuid

        tables = [np.stack([c.to_numpy(zero_copy_only=False).astype("<f8") for c in batch.columns], 1) for batch in batches]
        rows = np.concatenate(tables) if tables else np.zeros((0, len(columns)))
        if len(rows):
            os.makedirs(folder, exist_ok=True)
            head = "ply\nformat binary_little_endian 1.0\n" + f"element vertex {len(rows)}\n" + "".join(f"property double {c}\n" for c in columns) + "end_header\n"
            name = f"{folder}/part-{uuid.uuid4().hex}"
            with open(f"{name}.tmp", "wb") as out:
                out.write(head.encode() + rows.tobytes())
            os.replace(f"{name}.tmp", f"{name}.ply")
        yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64())], names=["n"])

    return points.select(*columns).mapInArrow(run, "n long").agg(F.sum("n")).head()[0] or 0


def save_map(voxels: DataFrame, path: str, params: MapParams, info: dict[str, str] | None = None) -> None:
    """Voxels as Parquet clustered by region, parameters and named values as one small table beside them."""
    from gridloom.operators.maps import REGION, with_region

    with_region(voxels, params).repartition(*REGION).sortWithinPartitions(*REGION).write.mode("overwrite").parquet(f"{path}/voxels")
    rows = [("params", json.dumps(asdict(params)))] + sorted((f"info.{k}", v) for k, v in (info or {}).items())
    voxels.sparkSession.createDataFrame(rows, "name string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/header")


def load_header(spark: SparkSession, path: str) -> tuple[MapParams, dict[str, str]]:
    """Parameters and named values, without reading a voxel."""
    rows = {r["name"]: r["value"] for r in spark.read.parquet(f"{path}/header").collect()}
    own = json.loads(rows.pop("params"))
    return MapParams(**own | {"origin": tuple(own["origin"])}), {k.removeprefix("info."): v for k, v in rows.items()}


def load_map(spark: SparkSession, path: str) -> tuple[DataFrame, MapParams, dict[str, str]]:
    from gridloom.operators.maps import REGION

    return (spark.read.parquet(f"{path}/voxels").drop(*REGION), *load_header(spark, path))


def save_heightmap(surface: DataFrame, path: str, info: dict[str, str]) -> None:
    """A heightmap with what it was made with (axis, clearance, floor, ceiling ...)."""
    surface.write.mode("overwrite").parquet(f"{path}/columns")
    surface.sparkSession.createDataFrame(sorted(info.items()), "name string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/info")


def load_heightmap(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    info = {r["name"]: r["value"] for r in spark.read.parquet(f"{path}/info").collect()}
    if "up_axis" not in info:
        raise ValueError("not a heightmap: it has no up axis")
    return spark.read.parquet(f"{path}/columns"), info


# The heading of statistics files.
STATISTICS = ("process_time_start", "process_time_end", "data_time_start", "data_time_end", "ray_count", "ray_length_minimum", "ray_length_maximum", "ray_length_average", "rays_per_second_data", "rays_per_second_process")


def write_statistics(stats: DataFrame, path: str) -> None:
    """Statistics of batches as CSV with the fixed heading; columns that stats lacks are empty."""
    own = [F.col(c).cast("string") if c in stats.columns else F.lit(None).cast("string") for c in STATISTICS]
    stats.select(*[c.alias(n) for c, n in zip(own, STATISTICS, strict=True)]).write.mode("overwrite").option("header", True).csv(path)
