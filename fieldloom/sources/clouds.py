"""Point clouds from files, one row for each point, and back.

Files are read by Spark's binary reader, so they may lie wherever Spark can read, and are taken apart in Arrow batches: a
file is one row until then, and must fit in a task's memory. Layouts: `kitti`, little-endian floats x, y, z, intensity;
`nuscenes`, x, y, z, intensity of 0 to 255, ring; `pcd`, a header and ascii or binary rows with at least x, y, z. What
is after the last whole point of a file is left out; an unreadable header is an error that names the file.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS = "cloud string, place int, x double, y double, z double, intensity double, ring int"
PCD_TYPES = {("F", "4"): "<f4", ("F", "8"): "<f8", ("U", "1"): "u1", ("U", "2"): "<u2", ("U", "4"): "<u4", ("I", "1"): "i1", ("I", "2"): "<i2", ("I", "4"): "<i4"}


def flat(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, "<f4", len(data) // (4 * width) * width).reshape(-1, width).astype(float)


def columns_of(data: bytes, layout: str, name: str) -> dict[str, np.ndarray]:
    """The fields of one file's points."""
    if layout == "kitti":
        return dict(zip(("x", "y", "z", "intensity"), flat(data, 4).T, strict=True))
    if layout == "nuscenes":
        found = dict(zip(("x", "y", "z", "intensity", "ring"), flat(data, 5).T, strict=True))
        return found | {"intensity": found["intensity"] / 255.0}
    head, at = {}, 0
    while "DATA" not in head:
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"{name}: no PCD header")
        key, *rest = data[at:end].decode("ascii", "replace").split() or [""]
        at, head[key] = end + 1, rest
    fields, n = head.get("FIELDS", []), int(head.get("POINTS", ["0"])[0])
    if not {"x", "y", "z"} <= set(fields):
        raise ValueError(f"{name}: no x, y, z among {fields}")
    if head["DATA"] == ["ascii"]:
        rows = [r.split() for r in data[at:].decode("ascii").splitlines()[:n]]
        return {f: np.array([r[k] for r in rows if len(r) >= len(fields)], float) for k, f in enumerate(fields)}
    if head["DATA"] != ["binary"]:
        raise ValueError(f"{name}: PCD data of kind {head['DATA']} is not read")
    kind = np.dtype([(f, PCD_TYPES[t, s]) for f, t, s in zip(fields, head["TYPE"], head["SIZE"], strict=True)])
    rows = np.frombuffer(data, kind, min(n, (len(data) - at) // kind.itemsize), at)
    return {f: rows[f].astype(float) for f in fields}


def read_clouds(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """POINTS of all files at a path; `cloud` is a file's name without its ending, `place` a point's place in it."""
    if layout not in ("kitti", "nuscenes", "pcd"):
        raise ValueError(f"no such layout: {layout}")
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("cloud"), "content")

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("cloud").to_pylist(), batch.column("content"), strict=True):
                found = columns_of(data.as_py(), layout, name)
                n = len(found["x"])
                ring = pa.array(found["ring"].astype(np.int32)) if "ring" in found else pa.nulls(n, pa.int32())
                intensity = pa.array(found["intensity"]) if "intensity" in found else pa.nulls(n, pa.float64())
                arrays = [pa.array([name] * n, pa.string()), pa.array(np.arange(n), pa.int32()), *(pa.array(found[c]) for c in "xyz"), intensity, ring]
                yield pa.RecordBatch.from_arrays(arrays, names=["cloud", "place", "x", "y", "z", "intensity", "ring"])

    return files.mapInArrow(run, POINTS)
