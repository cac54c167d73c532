"""Fingerprints of documents by improbable features.

Every run of `WINDOW` bytes is a feature; its entropy falls in one of a thousand bins, and a bin's rank is how rarely
the corpus has it (counted over all windows of all texts). In each span of `SPAN` following features the one of lowest
rank, the leftmost of equals, gets a point; features with `POINTS` points or more are the improbable ones. They are
hashed into a chain of Bloom filters, `FILTER_FEATURES` different ones to a filter, in the order of the text. Two
fingerprints are as like as the filters of the shorter are to their best partners in the longer, each weighed by its
features: the bits in common beyond chance, as a share of the most there could be.

Windows below `LEAST_BIN` (next to no entropy) are never features, and where a text has fewer spans than `POINTS` a
feature needs a point from each. Texts under `SHORT` bytes have too few spans to choose from: all their runs of
`SHORT_WINDOW` bytes are features (the whole text, if shorter). Null and empty texts, and those of no feature at all,
have the empty fingerprint, like nothing but an empty one. Equal fingerprints have likeness 1. Rows are read one by
one, repeated ids included; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, text_chunks, written

WINDOW = 32
SPAN = 32
POINTS = 8
SHORT = 128
SHORT_WINDOW = 8
BINS = 1000
LEAST_BIN = 100
FILTER_BITS = 2048
FILTER_FEATURES = 160
FEATURE_BITS = 5
#: Bits in common count from this share of the way between chance and the most there could be.
CUT = 0.2
NEVER = np.int64(2**62)
PLACE = np.int64(2**32 - 1)


def entropy_steps() -> tuple[np.ndarray, int]:
    """What n * log2(n) grows by at each count n from 1 to the window's size, in units of 2**-20; its greatest value."""
    n = np.arange(WINDOW + 1, dtype=float)
    f = np.round(np.where(n > 0, n * np.log2(np.maximum(n, 1)), 0) * 2**20).astype(np.int64)
    return np.diff(f), int(f[-1])


def entropy_bins(data: np.ndarray) -> np.ndarray:
    """The bin of each window of the bytes, by where it starts. Whole numbers only, so that equal windows have equal bins.

    A window's sum of n * log2(n) over its bytes' counts follows from the one before it: the byte that comes adds by how
    often it is among the bytes before, the byte that goes takes by how often it is among those after.
    """
    if len(data) < WINDOW:
        return np.empty(0, np.int64)
    steps, most = entropy_steps()
    before, after = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for k in range(1, WINDOW):
        same = (data[k:] == data[:-k]).view(np.uint8)
        before[k:] += same
        after[:-k] += same
    come, gone = np.cumsum(steps[before]), np.cumsum(steps[after])
    sums = come[WINDOW - 1 :].copy()
    sums[1:] -= gone[: len(sums) - 1]
    return BINS + (-BINS * sums) // most


def valid_starts(data: np.ndarray, starts: np.ndarray, reach: int) -> np.ndarray:
    """Which of the places where `reach` bytes begin have all of them in one text."""
    sizes = np.diff(starts)
    ends = np.repeat(starts[1:], sizes)
    return np.arange(max(0, len(data) - reach + 1)) + reach <= ends[: max(0, len(data) - reach + 1)]


def learn_ranks(docs: DataFrame) -> list[int]:
    """The rank of each entropy bin: the rarest in all windows of all texts first, then the lower bin."""

    def run(batches):
        counts = np.zeros(BINS + 1, np.int64)
        for batch in batches:
            for _, _, data, starts in text_chunks(batch.column("text")):
                counts += np.bincount(entropy_bins(data)[valid_starts(data, starts, WINDOW)], minlength=BINS + 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], names=["bin", "n"])

    found = docs.select(F.col("text").cast("string")).mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    counts = dict(found.collect())  # at most a row for each bin
    order = sorted(range(BINS + 1), key=lambda b: (counts.get(b, 0), b))
    ranks = [0] * (BINS + 1)
    for rank, b in enumerate(order):
        ranks[b] = rank
    return ranks


class Digester:
    """Fingerprints of texts that lie one after another: for each (features in each filter, filters as rows of bytes)."""

    def __init__(self, ranks: list[int]):
        self.ranks = np.array(ranks, np.int64)
        self.ranks[:LEAST_BIN] = -1

    def chosen(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, place) of the improbable features, in the order of the texts."""
        sizes = np.diff(starts)
        rank = self.ranks[entropy_bins(data)]
        keys = np.where(rank >= 0, (rank << 32) | np.arange(len(rank)), NEVER)
        keys[~valid_starts(data, starts, WINDOW)] = NEVER
        least, width = keys, 1
        while width < SPAN:
            step = min(width, SPAN - width)
            least, width = np.minimum(least[: max(0, len(least) - step)], least[step:]), width + step
        least = least[valid_starts(data, starts, WINDOW + SPAN - 1)[: len(least)]]
        first = np.flatnonzero(np.append(True, least[1:] != least[:-1])) if len(least) else np.empty(0, np.int64)
        points = np.diff(np.append(first, len(least)))
        place = (least[first] & PLACE)[least[first] != NEVER]
        points = points[least[first] != NEVER]
        text = np.searchsorted(starts, place, "right") - 1
        spans = sizes[text] - (WINDOW + SPAN - 2)
        keep = (points >= np.minimum(POINTS, spans)) & (sizes[text] >= SHORT)
        return text[keep], place[keep]

    def __call__(self, data: np.ndarray, starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        text, place = self.chosen(data, starts)
        h = np.full(len(place), 0x51ED270B, np.uint64)
        if len(place):
            runs = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[place]
            for word in np.ascontiguousarray(runs).view("<u8").T:
                h = mix(h ^ word)
        sizes = np.diff(starts)
        short = np.flatnonzero((sizes > 0) & (sizes < SHORT))
        if len(short):
            whole = [data[starts[t] : starts[t + 1]].tobytes() for t in short.tolist()]
            runs = [[x[k : k + SHORT_WINDOW] for k in range(max(1, len(x) - SHORT_WINDOW + 1))] for x in whole]
            text = np.append(text, np.repeat(short, [len(r) for r in runs]))
            h = np.append(h, np.array([xxhash.xxh3_64_intdigest(x, seed=SHORT) for r in runs for x in r], np.uint64))
            order = np.argsort(text, kind="stable")
            text, h = text[order], h[order]
        order = np.lexsort((h, text))  # stable: of equal features the first comes first
        new = np.ones(len(order), bool)
        new[1:] = (text[order][1:] != text[order][:-1]) | (h[order][1:] != h[order][:-1])
        keep = np.sort(order[new])
        text, h = text[keep], h[keep]
        number = np.arange(len(text)) - np.searchsorted(text, text)
        n_features = np.bincount(text, minlength=len(sizes))
        n_filters = -(-n_features // FILTER_FEATURES)
        base = np.append(0, np.cumsum(n_filters))
        row = base[text] + number // FILTER_FEATURES
        bits = np.zeros((int(base[-1]), FILTER_BITS), bool)
        for k in range(FEATURE_BITS):
            bits[row, ((h >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
        filters, counts = np.packbits(bits, axis=1), np.bincount(row, minlength=int(base[-1]))
        return [(counts[i:j], filters[i:j]) for i, j in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]

    def of_texts(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        return self(np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64))


def as_text(digest: tuple[np.ndarray, np.ndarray]) -> str:
    """features:base64 of each filter, comma-joined."""
    return ",".join(f"{n}:{base64.b64encode(f.tobytes()).decode()}" for n, f in zip(digest[0].tolist(), digest[1], strict=True))


def from_text(fingerprint: str | None) -> tuple[np.ndarray, np.ndarray]:
    parts = [x.split(":") for x in fingerprint.split(",")] if fingerprint else []
    filters = np.frombuffer(b"".join(base64.b64decode(f) for _, f in parts), np.uint8).reshape(len(parts), FILTER_BITS // 8)
    return np.array([int(n) for n, _ in parts], np.int64), filters


def one_way(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """How like the filters of `a` are to their best partners in `b`, weighed by their features."""
    (n_a, x), (n_b, y) = a, b
    set_b, total = np.bitwise_count(y).sum(axis=1, dtype=np.int64), 0.0
    unset = 1 - 1 / FILTER_BITS
    for n, f in zip(n_a.tolist(), x, strict=True):
        both = np.bitwise_count(y & f).sum(axis=1, dtype=np.int64)
        most = np.minimum(int(np.bitwise_count(f).sum(dtype=np.int64)), set_b)
        k, m = FEATURE_BITS * n, FEATURE_BITS * n_b
        chance = FILTER_BITS * (1 - unset**k - unset**m + unset ** (k + m))
        low = chance + CUT * (most - chance)
        score = np.where(most > low, (both - low) / np.where(most > low, most - low, 1), 0)
        total += n * float(np.clip(score, 0, 1).max())
    return total / float(n_a.sum())


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """0 to 1. The shorter chain is held against the longer; of two as long, each against the other, and the mean."""
    if len(a[0]) == len(b[0]) and np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1]):
        return 1.0
    if not len(a[0]) or not len(b[0]):
        return 0.0
    if len(a[0]) == len(b[0]):
        return (one_way(a, b) + one_way(b, a)) / 2
    return one_way(a, b) if len(a[0]) < len(b[0]) else one_way(b, a)


def fingerprints(docs: DataFrame, ranks: list[int] | None = None) -> DataFrame:
    """doc_id, n_chars, fingerprint of each row. With the `ranks` of an earlier run its fingerprints can be compared."""
    shared = docs.sparkSession.sparkContext.broadcast(learn_ranks(docs) if ranks is None else ranks)

    def run(batches):
        digest = Digester(shared.value)
        for batch in batches:
            out = []
            for _, _, data, starts in text_chunks(batch.column("text")):
                out += map(as_text, digest(data, starts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_chars"), pa.array(out, pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_chars"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def compared(pairs: DataFrame, a: str, b: str, name: str = "likeness") -> DataFrame:
    """`pairs` with the likeness of two columns of fingerprints; null where one of them is."""

    def score(batches):
        for batch in batches:
            both = zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)
            found = [None if x is None or y is None else 1.0 if x == y else likeness(from_text(x), from_text(y)) for x, y in both]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, pa.float64())], names=["row", "likeness"])

    kind = pairs.schema
    packed = pairs.select(F.struct(*(F.col(f"`{c}`") for c in pairs.columns)).alias("row"), F.col(a).alias("a"), F.col(b).alias("b"))
    scored = packed.mapInArrow(score, f"row {kind.simpleString()}, likeness double")
    return scored.select("row.*", F.col("likeness").alias(name))


TRIAL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edit_trial(docs: DataFrame, ranks: list[int] | None = None) -> DataFrame:
    """How fingerprints stand an edit: every text against itself with its last quarter replaced by the next document's
    first characters, and against the next document.

    Documents follow each other by doc_id (null ids first, equal ones by a hash of the text), the first after the last.
    Texts are dealt out by ranges of that order, once. A task lacks what follows its last row: it hands that row and its
    first one on whole, and the two ends of neighbouring ranges meet in a join of two rows for each range.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(learn_ranks(docs) if ranks is None else ranks)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")

    def trials(digest, ids, texts, prints):
        """A row of TRIAL for each text but the last, which only follows."""
        edited = []
        for text, after in zip(texts[:-1], texts[1:], strict=True):
            n = len(text) // 4
            edited.append((text[: len(text) - n] + after[:n]).encode())
        marks = digest.of_texts(edited)
        for k, (i, x) in enumerate(zip(ids[:-1], edited, strict=True)):
            yield i, len(texts[k]), hashlib.sha256(x).hexdigest(), as_text(prints[k]), as_text(marks[k]), likeness(prints[k], marks[k]), likeness(prints[k], prints[k + 1])

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string()]
    names = [x.split()[0] for x in TRIAL.split(", ")] + ["range", "head", "tail"]

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds[: len(out[0])])], names=names[: len(out[0])])

    def run(batches):
        digest, at = Digester(shared.value), TaskContext.get().partitionId()
        ids, texts, prints, head = [], [], [], True
        for batch in batches:
            column, known = batch.column("text"), batch.column("doc_id").to_pylist()
            for a, b, data, starts in text_chunks(column):
                ids, texts, prints = ids[-1:] + known[a:b], texts[-1:] + column.slice(a, b - a).to_pylist(), prints[-1:] + digest(data, starts)
                out = []
                for row in trials(digest, ids, texts, prints):
                    out.append((*row, at, texts[0] if head else None, None))
                    head = False
                if out:
                    yield batch_of(out)
        if ids:
            yield batch_of([(ids[-1], len(texts[-1]), None, as_text(prints[-1]), None, None, None, at, texts[-1] if head else None, texts[-1])])

    found = written(rows.mapInArrow(run, f"{TRIAL}, range int, head string, tail string"), "trials", "zstd")
    ranges = sorted(r[0] for r in found.where(F.col("head").isNotNull()).select("range").collect())  # one for each task
    follows = spark.createDataFrame(list(zip(ranges, ranges[1:] + ranges[:1], strict=True)), "range int, follows int")
    ends = found.where(F.col("tail").isNotNull()).select("range", "doc_id", "tail", "fingerprint").join(F.broadcast(follows), "range")
    heads = found.where(F.col("head").isNotNull()).select(F.col("range").alias("follows"), "head", F.col("fingerprint").alias("next"))

    def mend(batches):
        digest = Digester(shared.value)
        for batch in batches:
            for i, tail, x, head, y in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tail", "fingerprint", "head", "next")), strict=True):
                yield batch_of(list(trials(digest, [i, None], [tail, head], [from_text(x), from_text(y)])))

    mended = ends.join(heads, "follows").select("doc_id", "tail", "fingerprint", "head", "next").mapInArrow(mend, TRIAL)
    return found.where(F.col("tail").isNull()).select(*mended.columns).unionByName(mended)
