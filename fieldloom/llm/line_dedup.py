"""Removal of lines that many documents share, kept reversible by an index.

The index has three tables, all split by shards of the key's hash:

* postings: each key with each document that holds it, once;
* references: for each key the exact number of its documents and the largest doc_id among them;
* filters: for each shard a cuckoo filter of the keys that enough documents share.

Inserting documents raises counts, deleting documents lowers them, and keys that cross the threshold enter or leave
the filters, so an index after insertions and deletions equals one built from what is left. When lines are scrubbed,
only keys that a filter lets through meet the exact table; a filter has no false negatives, so nothing is lost.

A line's key is the line without `[\\x20\\x09-\\x0D]` at its ends, A-Z lower-cased. Keys shorter than `min_chars` code
points never count. Keys that `min_docs` or more documents hold lose all lines but those of the largest doc_id.
A null or empty text is one empty line. Rows with the same doc_id are one document; rows with a null doc_id keep all
lines and count for nothing. Extra columns of the input are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, mix, schema_text, written

MARGIN = b" \t\n\v\f\r"
KEY = ["h1", "h2"]
SLOTS = 4


def line_key(line: bytes, min_chars: int) -> tuple[int, int] | None:
    """Two signed 64-bit halves of the key's hash; None for a key that is too short."""
    key = line.strip(MARGIN)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
        return None
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(key.lower()), ">i8").tolist())


def postings_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id), once for each key of a row."""

    def run(batches):
        for batch in batches:
            h1, h2, ids = [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if doc_id is not None and text:
                    keys = {line_key(x, min_chars) for x in text.split(b"\n") if len(x) >= min_chars}
                    keys.discard(None)
                    for a, b in keys:
                        h1.append(a)
                        h2.append(b)
                    ids.extend([doc_id] * len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (h1, h2, ids)], names=["h1", "h2", "doc_id"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(giving_back(run), "h1 long, h2 long, doc_id long")


class CuckooFilter:
    """Four 16-bit fingerprints in each of a power of two buckets; a key lies in one of two buckets.

    The second bucket is found from the first and the fingerprint alone, so keys can be deleted again.
    """

    def __init__(self, keys: int = 0, table: np.ndarray | None = None):
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, keys) / SLOTS / 0.75 + 1))))
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(table=np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix(h.astype(np.uint64))
        mark = ((h >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        one = (h & np.uint64(len(self.table) - 1)).astype(np.int64)
        return mark, one, self.other(one, mark)

    def other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(mark.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, h: np.ndarray) -> np.ndarray:
        mark, one, two = self.places(h)
        return ((self.table[one] == mark[:, None]) | (self.table[two] == mark[:, None])).any(axis=1)

    def insert(self, h: np.ndarray) -> bool:
        """False if the filter is too full; then a larger one has to be built."""
        mark, one, two = self.places(h)
        rest = np.arange(len(h))
        for bucket in (one, two):  # most keys find room in their first or second bucket: all at once
            order = rest[np.argsort(bucket[rest], kind="stable")]
            b = bucket[order]
            rank = np.arange(len(b)) - np.searchsorted(b, b)
            free = np.argsort(self.table[b] != 0, axis=1, kind="stable")
            fits = rank < (self.table[b] == 0).sum(axis=1)
            self.table[b[fits], free[fits, rank[fits]]] = mark[order[fits]]
            rest = order[~fits]
        for m, b in zip(mark[rest], one[rest], strict=True):
            for kick in range(500):
                empty = np.flatnonzero(self.table[b] == 0)
                if len(empty):
                    self.table[b, empty[0]] = m
                    break
                slot = (int(m) + kick) % SLOTS
                m, self.table[b, slot] = self.table[b, slot], m
                b = int(self.other(np.array([b]), np.array([m]))[0])
            else:
                return False
        return True

    def delete(self, h: np.ndarray) -> None:
        for m, one, two in zip(*self.places(h), strict=True):
            for b in (one, two):
                found = np.flatnonzero(self.table[b] == m)
                if len(found):
                    self.table[b, found[0]] = 0
                    break


def shard(n: int) -> F.Column:
    return F.pmod(F.col("h2"), F.lit(n)).cast("int")


def filters_of(keys: DataFrame, n: int) -> DataFrame:
    """(shard, filter) from keys; a shard that overflows is built again with twice the room."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        h, room = group["h1"].to_numpy().view(np.uint64), len(group)
        while not (made := CuckooFilter(room)).insert(h):
            room *= 2
        return pd.DataFrame({"shard": [group["shard"].iloc[0]], "filter": [made.to_bytes()]})

    return keys.select(shard(n).alias("shard"), "h1").groupBy("shard").applyInPandas(build, "shard int, filter binary")


def changed_filters(filters: DataFrame, change: DataFrame, exact: DataFrame, n: int) -> DataFrame:
    """Filters after keys entered (up) or left; a shard without room for the new ones is built from its exact keys."""
    full = exact.select(shard(n).alias("shard"), "h1", F.lit(None).cast("boolean").alias("up"))
    moves = change.select(shard(n).alias("shard"), "h1", "up")
    touched = moves.select("shard").distinct()
    rows = moves.unionByName(full.join(touched, "shard", "left_semi"))

    def update(key, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        if not len(new):
            return old
        up, down = (new.loc[new["up"].eq(flag) & new["up"].notna(), "h1"].to_numpy().view(np.uint64) for flag in (True, False))
        made = CuckooFilter.from_bytes(old["filter"].iloc[0]) if len(old) else None
        if made is not None:
            made.delete(down)
        if made is None or not made.insert(up):
            h = new.loc[new["up"].isna(), "h1"].to_numpy().view(np.uint64)
            room = len(h)
            while not (made := CuckooFilter(room)).insert(h):
                room *= 2
        return pd.DataFrame({"shard": [key[0]], "filter": [made.to_bytes()]})

    return filters.groupBy("shard").cogroup(rows.groupBy("shard")).applyInPandas(update, "shard int, filter binary")


def let_through(postings: DataFrame, filters: DataFrame, n: int, most: int = 250_000) -> DataFrame:
    """Postings whose key a filter may hold. A shard with more than `most` postings is dealt over as many groups as
    that takes, each with the shard's filter, so that a key with a large share of all postings fills none of them."""
    postings = postings.withColumn("shard", shard(n))
    groups = postings.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("groups"))
    salted = postings.join(groups, "shard").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("groups")).cast("int")).drop("groups")
    spread = filters.join(groups, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")

    def test(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return left.iloc[:0][["h1", "h2", "doc_id"]]
        found = CuckooFilter.from_bytes(right["filter"].iloc[0]).contains(left["h1"].to_numpy().view(np.uint64))
        return left.loc[found, ["h1", "h2", "doc_id"]]

    return salted.groupBy("shard", "salt").cogroup(spread.groupBy("shard", "salt")).applyInPandas(test, "h1 long, h2 long, doc_id long")


def counted(postings: DataFrame) -> DataFrame:
    return postings.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))


@dataclass(frozen=True)
class LineIndex:
    postings: DataFrame
    references: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int = 3
    min_chars: int = 20

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = 3, min_chars: int = 20, keys_per_shard: int = 250_000) -> LineIndex:
        postings = written(postings_of(docs, min_chars).distinct(), "postings")
        shards = max(8, -(-postings.count() // keys_per_shard))
        references = written(counted(postings), "references")
        filters = written(filters_of(references.where(F.col("n_docs") >= min_docs), shards), "filters")
        return cls(postings, references, filters, shards, min_docs, min_chars)

    def _after(self, postings: DataFrame, references: DataFrame, touched: DataFrame) -> LineIndex:
        postings, references = written(postings, "postings"), written(references, "references")
        shared = F.coalesce(F.col("n_docs"), F.lit(0)) >= self.min_docs
        old = touched.join(self.references, KEY, "left").select(*KEY, shared.alias("was"))
        new = touched.join(references, KEY, "left").select(*KEY, shared.alias("up"))
        change = old.join(new, KEY).where(F.col("was") != F.col("up"))
        filters = changed_filters(self.filters, change, references.where(F.col("n_docs") >= self.min_docs), self.shards)
        return replace(self, postings=postings, references=references, filters=written(filters, "filters"))

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with these documents too; what it has of them already counts once."""
        fresh = written(postings_of(docs, self.min_chars).distinct().join(self.postings, [*KEY, "doc_id"], "left_anti"), "fresh")
        both = self.references.unionByName(counted(fresh))
        references = both.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))
        return self._after(self.postings.unionByName(fresh), references, fresh.select(*KEY).distinct())

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """The index without these documents; keys that only they held are gone."""
        gone = doc_ids.select(F.col("doc_id").cast("long")).distinct()
        touched = written(self.postings.join(gone, "doc_id", "left_semi").select(*KEY).distinct(), "touched")
        left = self.postings.join(gone, "doc_id", "left_anti")
        again = counted(left.join(touched, KEY, "left_semi"))
        return self._after(left, self.references.join(touched, KEY, "left_anti").unionByName(again), touched)

    def scrub(self, docs: DataFrame, postings: DataFrame | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
        """doc_id, text (kept lines), n_lines, n_dropped of each row, and the columns to carry along.

        `postings` are those of `docs`, where they are at hand.
        """
        postings = postings_of(docs, self.min_chars).distinct() if postings is None else postings
        shared = self.references.where(F.col("n_docs") >= self.min_docs).select(*KEY, "keeper")
        drops = let_through(postings, self.filters, self.shards).join(shared, KEY).where(F.col("doc_id") != F.col("keeper"))
        by_doc = drops.groupBy("doc_id").agg(F.collect_list("h1").alias("drop1"), F.collect_list("h2").alias("drop2"))
        rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *carry).join(by_doc, "doc_id", "left")
        min_chars = self.min_chars

        def run(batches):
            for batch in batches:
                kept, n_lines, n_dropped = [], [], []
                columns = (batch.column(c) for c in ("text", "drop1", "drop2"))
                texts, drop1, drop2 = (c.cast(pa.binary()).to_pylist() if k == 0 else c.to_pylist() for k, c in enumerate(columns))
                for text, a, b in zip(texts, drop1, drop2, strict=True):
                    lines = (text or b"").split(b"\n")
                    n_lines.append(len(lines))
                    if a:
                        drop = set(zip(a, b, strict=True))
                        lines = [x for x in lines if line_key(x, min_chars) not in drop]
                    n_dropped.append(n_lines[-1] - len(lines))
                    kept.append(b"\n".join(lines))
                arrays = [batch.column("doc_id"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), *map(batch.column, carry)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text", "n_lines", "n_dropped", *carry])

        return rows.mapInArrow(giving_back(run), f"doc_id long, text string, n_lines long, n_dropped long{schema_text(docs, carry)}")


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, carry: tuple[str, ...] = ()) -> DataFrame:
    """Scrubs documents against an index of themselves: doc_id, text, n_lines, n_dropped, and what is carried along."""
    index = LineIndex.build(docs, min_docs, min_chars)
    return index.scrub(docs, index.postings, carry)
