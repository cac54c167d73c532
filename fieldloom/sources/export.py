"""Exports that can be stopped and resumed: records in chunks by hash, a digest for each, a manifest, a commit.

Records go to chunks by a hash of their frame, so a change of one record changes one chunk. A run writes the chunks that
the manifest lacks or holds with another digest, some at a time, each batch into a folder of its own; the batch's rows
are added to the manifest after its data. A run that dies leaves what is in the manifest, and perhaps a folder that
nothing names. The commit is written when every chunk is there; its id is a seal of the specification, the vocabulary's
version and all digests, so it does not depend on how often the run was resumed.

Record columns, order and types are fixed values; nested ones are JSON text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sets
from . import formats
from .lake import conform, declared

# The columns of a record.
RECORD = """object_id string, frame_id string, session_id string, track_id string, ts_ns bigint, cam_id string, img_uri string,
    width int, height int, vehicle_id string, city string, class_id int, class_name string, bbox_x1 double, bbox_y1 double,
    bbox_x2 double, bbox_y2 double, conf double, quality_score double, state string, source string, mask_uri string,
    mask_encoding string, rot_deg double, keypoints_json string, polyline_json string, relationships_json string,
    attrs_json string, provenance_json string, split string"""
MANIFEST = "chunk int, n bigint, digest string, folder string, step bigint"
COMMIT = "commit_id string, spec string, vocabulary string, n bigint, chunks int, formats array<string>"


def records(df: DataFrame) -> DataFrame:
    """The 30 columns in their order; nested values become JSON, those that are missing are null."""
    schema = declared(RECORD)
    nested = {f"{c}_json": c for c in ("keypoints", "polyline", "relationships", "attrs", "provenance")}
    for name, c in nested.items():
        if c in df.columns and name not in df.columns:
            df = df.withColumn(name, F.to_json(c))
    return conform(df, schema).withColumn("rot_deg", F.coalesce("rot_deg", F.lit(0.0))).withColumn("split", F.coalesce("split", F.lit("train")))


def chunk_of(n_chunks: int):
    return F.pmod(F.xxhash64(F.coalesce("frame_id", F.lit(""))), F.lit(n_chunks)).cast("int")


def digests(rows: DataFrame, n_chunks: int) -> DataFrame:
    """(chunk, n, digest) of the chunks that have rows, whatever the rows' order."""
    found = sets.fingerprint(rows.withColumn("chunk", chunk_of(n_chunks)), rows.columns, "chunk")
    return found.select("chunk", "n", F.col("seal").alias("digest"))


def table_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def manifest(spark: SparkSession, path: str) -> list:
    """The last row of each chunk: as many as chunks."""
    found = table_or_none(spark, f"{path}/manifest", MANIFEST)
    if found is None:
        return []
    return found.groupBy("chunk").agg(F.max_by(F.struct("n", "digest", "folder", "step"), "step").alias("x")).select("chunk", "x.*").collect()


def export(rows: DataFrame, path: str, spec: str, vocabulary: str, chunk_rows: int = 1_000_000, at_once: int = 64, others: tuple[str, ...] = ()) -> DataFrame:
    """One row: the commit, with `written`, the chunks that this run wrote. `rows`: columns of a record; `others`: further formats.

    The number of chunks is that of the first run. An unknown format is refused before anything is written."""
    writers: dict[str, Callable] = {f: formats.writer(f) for f in others}
    spark, rows = rows.sparkSession, records(rows)
    known = {r["chunk"]: r for r in manifest(spark, path)}
    shape = table_or_none(spark, f"{path}/shape", "chunks int")
    if shape is None:
        n_chunks = max(1, -(-rows.count() // chunk_rows))
        spark.createDataFrame([(n_chunks,)], "chunks int").write.parquet(f"{path}/shape")
    else:
        n_chunks = shape.first()["chunks"]
    now = {r["chunk"]: r for r in digests(rows, n_chunks).collect()}  # a row for each chunk
    todo = sorted(c for c, r in now.items() if c not in known or (known[c]["n"], known[c]["digest"]) != (r["n"], r["digest"]))
    gone = [c for c, r in known.items() if c not in now and r["n"]]
    step = max((r["step"] for r in known.values()), default=0)
    chunked = rows.withColumn("chunk", chunk_of(n_chunks))
    for a in range(0, len(todo), at_once):
        part, step, folder = todo[a : a + at_once], step + 1, uuid.uuid4().hex
        chunked.where(F.col("chunk").isin(part)).repartition("chunk").write.partitionBy("chunk").parquet(f"{path}/data/{folder}")
        spark.createDataFrame([(c, now[c]["n"], now[c]["digest"], folder, step) for c in part], MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    if gone:
        spark.createDataFrame([(c, 0, "", "", step + 1) for c in gone], MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    for name, write in writers.items():
        boxes = rows.select(F.col("img_uri").alias("image_ref"), "width", "height", "class_name", *(F.col(f"bbox_{c}").alias(c) for c in ("x1", "y1", "x2", "y2")), "conf")
        write(boxes, f"{path}/{name}")
    every = spark.createDataFrame([(c, r["n"], r["digest"]) for c, r in now.items()], "chunk int, n bigint, digest string")
    seal = sets.fingerprint(every, ["chunk", "n", "digest"]).first()
    named = F.substring(F.sha2(F.concat_ws("\n", F.lit(str(len(spec))), F.lit(spec), F.lit(vocabulary), F.lit(seal["seal"] if seal else "")), 256), 1, 16)
    row = [(spec, vocabulary, sum(r["n"] for r in now.values()), n_chunks, ["parquet", *others])]
    commit = spark.createDataFrame(row, "spec string, vocabulary string, n bigint, chunks int, formats array<string>").select(named.alias("commit_id"), "*")
    commit.coalesce(1).write.mode("overwrite").parquet(f"{path}/commit")
    return commit.withColumn("written", F.lit(len(todo)))


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """The records that the manifest names."""
    folders: dict[str, list[int]] = {}
    for r in manifest(spark, path):
        if r["n"]:
            folders.setdefault(r["folder"], []).append(r["chunk"])
    out = spark.createDataFrame([], RECORD)
    for folder, chunks in sorted(folders.items()):
        found = spark.read.schema(f"{RECORD}, chunk int").parquet(f"{path}/data/{folder}")
        out = out.unionByName(found.where(F.col("chunk").isin(chunks)).drop("chunk"))
    return out


def round_trip(spark: SparkSession, path: str) -> DataFrame:
    """(chunk, n, n_read, same): whether what is read back is what the manifest says."""
    told = spark.createDataFrame([(r["chunk"], r["n"], r["digest"]) for r in manifest(spark, path) if r["n"]], "chunk int, n bigint, digest string")
    n_chunks = spark.read.schema("chunks int").parquet(f"{path}/shape").first()["chunks"]
    read = digests(read_export(spark, path), n_chunks).select("chunk", F.col("n").alias("n_read"), F.col("digest").alias("_read"))
    return told.join(read, "chunk", "full").select("chunk", "n", "n_read", F.col("digest").eqNullSafe(F.col("_read")).alias("same"))
