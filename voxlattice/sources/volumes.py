"""Volumes as brick tables: reading files and slices, writing them back, and what a run stores."""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BRICKS = "path string, bz int, by int, bx int, nz int, ny int, nx int, data binary"


def decode_npy(raw: bytes) -> np.ndarray:
    """A .npy file, or the only array of a .npz file."""
    found = np.load(io.BytesIO(raw), allow_pickle=False)
    return found[found.files[0]] if hasattr(found, "files") else found


def squeeze(volume: np.ndarray, transposed: bool = False) -> np.ndarray:
    """Three axes z, y, x: single axes of a fourth dropped, a plane given one; `transposed` files hold x, y, z."""
    v = np.squeeze(volume) if volume.ndim > 3 else volume
    v = v[None] if v.ndim == 2 else v
    if v.ndim != 3:
        raise ValueError(f"a volume has three axes, not {volume.shape}")
    return v.transpose(2, 1, 0) if transposed else v


def cut(path: str, volume: np.ndarray, edge: int):
    for b in np.ndindex(tuple(-(-n // edge) for n in volume.shape)):
        part = np.ascontiguousarray(volume[tuple(slice(k * edge, (k + 1) * edge) for k in b)], dtype="<f4")
        yield (path, *map(int, b), *part.shape, part.tobytes())


def read_volumes(spark: SparkSession, glob: str, edge: int = 64, decode: Callable[[bytes], np.ndarray] = decode_npy, transposed: bool = False) -> DataFrame:
    """Bricks of every file that matches: little-endian float32, z, y, x order. One file at a time is decoded in a task."""

    def run(batches):
        for b in batches:
            for path, raw in zip(b["path"], b["content"]):
                rows = list(cut(path, squeeze(decode(raw), transposed), edge))
                for k in range(0, len(rows), 64):
                    yield pd.DataFrame(rows[k : k + 64], columns=[c.split()[0] for c in BRICKS.split(", ")])

    return spark.read.format("binaryFile").load(glob).select("path", "content").mapInPandas(run, BRICKS)


def luminance(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image[..., :3] @ np.array([0.299, 0.587, 0.114])


def stack_slices(slices: DataFrame, edge: int, decode: Callable[[bytes], np.ndarray] = decode_npy) -> DataFrame:
    """Bricks of a table (path, z, content) of images: each layer of bricks stacks only its own slices.

    Slices of a stack that differ in shape raise an error.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("z")
        planes = [luminance(decode(raw)) for raw in frame["content"]]
        if len({p.shape for p in planes}) != 1:
            raise ValueError(f"slices of {frame['path'].iloc[0]} differ in shape")
        layer = int(frame["bz"].iloc[0])
        rows = [(p, layer, *rest) for p, _, *rest in cut(frame["path"].iloc[0], np.stack(planes), edge)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in BRICKS.split(", ")])

    return slices.withColumn("bz", F.floor(F.col("z") / edge).cast("int")).groupBy("path", "bz").applyInPandas(run, BRICKS)


def voxels_of(bricks: DataFrame, edge: int) -> DataFrame:
    """Long form (path, z, y, x, v); for small volumes."""

    def run(batches):
        for b in batches:
            for r in b.itertuples(index=False):
                z, y, x = np.indices((r.nz, r.ny, r.nx)).reshape(3, -1)
                yield pd.DataFrame({"path": r.path, "z": z + r.bz * edge, "y": y + r.by * edge, "x": x + r.bx * edge, "v": np.frombuffer(r.data, "<f4").astype(float)})

    return bricks.mapInPandas(run, "path string, z long, y long, x long, v double")


def brick_moments(bricks: DataFrame) -> DataFrame:
    """(path, n, mean, std, min, max) per volume from each brick's partial sums; values that are not finite are missing."""

    def run(batches):
        for b in batches:
            rows = []
            for path, raw in zip(b["path"], b["data"]):
                v = np.frombuffer(raw, "<f4").astype(float)
                v = v[np.isfinite(v)]
                rows.append((path, len(v), v.sum(), (v * v).sum(), v.min() if len(v) else None, v.max() if len(v) else None))
            yield pd.DataFrame(rows, columns=["path", "n", "s", "q", "lo", "hi"])

    p = bricks.select("path", "data").mapInPandas(run, "path string, n long, s double, q double, lo double, hi double")
    out = p.groupBy("path").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("lo").alias("min"), F.max("hi").alias("max"))
    mean = F.col("s") / F.col("n")
    return out.select("path", "n", mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"), "min", "max")


def write_result(tables: dict[str, DataFrame], folder: str) -> None:
    """A run's tables as Parquet, those with a frame in a folder a frame; frames written again replace their own only."""
    for name, t in tables.items():
        keys = [k for k in ("sample_id", "frame") if k in t.columns]
        w = t.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        (w.partitionBy(*keys) if keys else w).parquet(f"{folder}/{name}")


def read_result(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def write_frames_csv(rows: DataFrame, folder: str) -> None:
    """Node rows as CSV, a folder a frame, with empty cells where a value is missing or not finite."""
    numbers = [f.name for f in rows.schema if f.dataType.simpleString() in ("double", "float")]
    clean = rows.withColumns({c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)) for c in numbers})
    clean.write.mode("overwrite").partitionBy("frame").option("header", True).option("nullValue", "").csv(folder)


def image_data(nodes: DataFrame, fields: list[str], *keys: str) -> DataFrame:
    """(keys, n_nodes, content): one image-data document (XML, ASCII) per frame of a full node grid."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values(["iz", "iy", "ix"])
        extent = " ".join(f"{f[a].min()} {f[a].max()}" for a in ("ix", "iy", "iz"))
        step = [float(np.diff(np.unique(f[a]))[0]) if f[a].nunique() > 1 else 1.0 for a in "xyz"]
        arrays = "".join(f'<DataArray type="Float64" Name="{n}" format="ascii">{" ".join(map(repr, f[n].astype(float)))}</DataArray>' for n in fields)
        text = f'<VTKFile type="ImageData"><ImageData WholeExtent="{extent}" Origin="{f["x"].min()} {f["y"].min()} {f["z"].min()}" Spacing="{step[0]} {step[1]} {step[2]}"><Piece Extent="{extent}"><PointData>{arrays}</PointData></Piece></ImageData></VTKFile>'
        return pd.DataFrame([(*(f[k].iloc[0] for k in keys), len(f), text)], columns=[*keys, "n_nodes", "content"])

    schema = ", ".join(f"{k} {nodes.schema[k].dataType.simpleString()}" for k in keys) + ", n_nodes long, content string"
    return nodes.groupBy(*keys).applyInPandas(run, schema)
