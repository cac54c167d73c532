"""What the operators share: tables in the shared folder, and hashing of words in NumPy.

Word hashes are 64 bits wide. A word is a run of bytes other than space and \\t..\\r; A-Z count as a-z.
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of more bytes are hashed one by one.
LONG_WORD = 256
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local master gets a
    temporary one; on a cluster that is an error, as each machine would write to its own disks."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """`df` as a new Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/fieldloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def schema_text(df: DataFrame, columns) -> str:
    """The DDL of some columns, for Arrow functions that hand them through; "" for none."""
    return "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def crc_mod(column: str, divisor: int) -> Column:
    """crc32 of the id written as decimal text, modulo `divisor`; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of unsigned 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def byte_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random value for each byte (equal for a letter's two cases), which bytes are space, powers of an odd base."""
    value = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    value[65:91] = value[97:123]
    space = np.zeros(256, bool)
    space[[32, 9, 10, 11, 12, 13]] = True
    powers = np.cumprod(np.full(LONG_WORD, 0xD6E8FEB86659FD93, np.uint64), dtype=np.uint64)
    return value, space, powers


def word_hashes(data: np.ndarray, starts: np.ndarray, tables: tuple, split=None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts that lie one after another in `data` (bytes), and the texts' bounds among them.

    `starts` has the place of each text's first byte, and the length of `data` at its end. `split` tells of the bytes
    which more are blank, and where more words begin.
    """
    value, space, powers = tables
    blank, begin = space[data], None
    if split is not None:
        more, begin = split(data)
        blank |= more
    at = np.flatnonzero(~blank)
    if not len(at):
        return np.empty(0, np.uint64), np.zeros(len(starts), np.int64)
    first = np.zeros(len(data) + 1, bool)
    first[starts] = True
    first[1:-1] |= blank[:-1]
    if begin is not None:
        first[:-1] |= begin
    begins = np.flatnonzero(first[at])
    lengths = np.diff(np.append(begins, len(at)))
    place = np.arange(len(at)) - np.repeat(begins, lengths)
    h = np.add.reduceat(value[data[at]] * powers[np.minimum(place, len(powers) - 1)], begins)
    h = mix(h + lengths.astype(np.uint64))
    for k in np.flatnonzero(lengths > len(powers)).tolist():
        word = data[at[begins[k]] : at[begins[k]] + lengths[k]].tobytes()
        h[k] = xxhash.xxh3_64_intdigest(word.lower(), seed=LONG_WORD)
    return h, np.searchsorted(at[begins], starts)


@contextmanager
def small_batches(spark: SparkSession, most: str = "8m"):
    """Within it, Arrow batches of what runs are of `most` bytes: batches of Spark's own size, several times over in each
    task's JVM and Python, are most of what a task holds."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def give_back() -> None:
    """Hands what Arrow and NumPy have freed back to the system: else a Python worker keeps the most that any of its tasks
    held, and takes it along into the queries that follow."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # another libc
        ctypes.CDLL(None).malloc_trim(0)


def giving_back(run):
    """An Arrow function of batches whose task ends with `give_back`."""

    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def slices(batches, most: int = 1 << 22):
    """Arrow batches cut into pieces of about `most` bytes, so that what a task makes of one stays small."""
    for batch in batches:
        rows = max(1, batch.num_rows * most // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_chunks(texts: pa.Array, most: int = 1 << 19):
    """Runs of texts of about `most` bytes: (first row, row after the last, bytes, bounds). Nulls are empty texts."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + most, "right")) - 1)
        yield a, b, data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
        a = b
