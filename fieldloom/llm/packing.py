"""Packing of documents into sequences by cutting-stock column generation.

A document's tokens are cut at multiples of the sequence length; what is left over is one piece. Piece lengths,
rounded up to a multiple of `unit`, form a histogram of at most capacity / unit bins, the only thing that reaches
the driver. There a linear program over patterns (how many pieces of each length share a sequence) is solved by
column generation: the simplex duals price a knapsack by dynamic programming, and its best pattern enters until none
improves. Pattern counts are rounded down, the few pieces left are placed first-fit decreasing, and the pieces of
each length, ranked by task and order in it, take the patterns' places by arithmetic in Spark.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_tables, giving_back, text_chunks, word_hashes, written

SEQUENCE = 2048
UNIT = 16
HELD_STEMS = 100_000
HELD_WORDS = 1_000_000


class WordEncoder:
    """Ids of words under a byte-level BPE with word ends, each distinct word of a task encoded once.

    A word of Latin letters, with or without a full stop or comma, goes straight to the merges: for it, normalising
    and pre-splitting change nothing but case. Any other word takes the tokenizer's whole path. Known words lie in
    arrays, sorted by their hash, with their ids in one pool: some 30 bytes for each.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.merges = self.whole.model
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.byte_names = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.stems: dict[str, list[int]] = {}
        self.hashes, self.offsets, self.sizes = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool = np.empty(0, np.uint32)

    def stem(self, word: str) -> list[int]:
        ids = self.stems.get(word)
        if ids is None:
            name = word if word.isascii() else "".join(map(self.byte_names.__getitem__, word.encode()))
            if len(self.stems) > HELD_STEMS:
                self.stems.clear()
            ids = self.stems[word] = [t.id for t in self.merges.tokenize(name)]
        return ids

    def word(self, word: bytes) -> list[int]:
        low = word.decode().lower()
        stem = low[:-1] if low[-1] in ".," else low
        if stem.isalpha() and max(low) < "Ā":
            return self.stem(stem) if stem is low else self.stem(stem) + self.stem(low[-1])
        return self.whole.encode(word.decode(), add_special_tokens=False).ids

    def find(self, hashes: np.ndarray, spell) -> np.ndarray:
        """Places of distinct words among the known; `spell` gives the bytes of those at some places of `hashes`.

        Beyond `HELD_WORDS` words, or as many ids for each as a long word has, all known ones are forgotten first."""
        if len(self.hashes) > HELD_WORDS or len(self.pool) > 16 * HELD_WORDS:
            self.hashes, self.offsets, self.sizes = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
            self.pool = np.empty(0, np.uint32)
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        new = np.flatnonzero(self.hashes[at] != hashes) if len(self.hashes) else np.arange(len(hashes))
        if not len(new):
            return at
        found = [self.word(w) for w in spell(new)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        offsets = len(self.pool) + np.cumsum(sizes) - sizes
        self.pool = np.append(self.pool, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())))
        by = np.argsort(all_ := np.append(self.hashes, hashes[new]))
        self.hashes, self.offsets, self.sizes = all_[by], np.append(self.offsets, offsets)[by], np.append(self.sizes, sizes)[by]
        return np.searchsorted(self.hashes, hashes)


def encode_texts(texts: pa.Array, encoder: WordEncoder):
    """(first row, row after the last, ids of all these texts, bounds of each text's ids)."""
    tables = byte_tables()
    for a, b, data, starts in text_chunks(texts, 1 << 20):
        hashes, bounds = word_hashes(data, starts, tables)
        if not len(hashes):
            yield a, b, np.empty(0, np.uint32), np.zeros(b - a + 1, np.int64)
            continue
        blank = tables[1][data]
        first = np.zeros(len(data) + 1, bool)
        first[starts] = True
        first[1:-1] |= blank[:-1]
        begins = np.flatnonzero(first[:-1] & ~blank)
        closing = np.append(blank, True)
        closing[starts] = True
        ends = np.flatnonzero(closing)
        which, distinct = pd.factorize(hashes)
        at = np.empty(len(distinct), np.int64)
        at[which[::-1]] = np.arange(len(hashes) - 1, -1, -1)

        def spell(places, at=at, begins=begins, ends=ends, raw=data.tobytes()):
            i = begins[at[places]]
            j = ends[np.searchsorted(ends, i, "right")]
            return [raw[x:y] for x, y in zip(i.tolist(), j.tolist(), strict=True)]

        word = encoder.find(distinct, spell)[which]
        n = encoder.sizes[word]
        upto = np.append(0, np.cumsum(n))
        yield a, b, encoder.pool[np.repeat(encoder.offsets[word] - upto[:-1], n) + np.arange(upto[-1])], upto[bounds]


def cut_pieces(
    docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = SEQUENCE, unit: int = UNIT, with_ids: bool = False
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, its length class, task and rank in the task."""
    ids_type = ", ids array<int>" if with_ids else ""
    schema = f"doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, task int, place long{ids_type}"

    def run(batches):
        encoder, task = WordEncoder(tokenizer_path), TaskContext.get().partitionId()
        seen = np.zeros(capacity // unit + 2, np.int64)
        for batch in batches:
            for a, b, flat, bounds in encode_texts(batch.column("text"), encoder):
                rows, pieces = [], []
                doc_ids = batch.column("doc_id").slice(a, b - a).to_pylist()
                for doc_id, i, j in zip(doc_ids, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    ids = np.append(flat[i:j], np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(ids), capacity):
                        part = ids[start : start + capacity]
                        kind = -(-len(part) // unit)
                        rows.append((doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids), kind, task, int(seen[kind])))
                        seen[kind] += 1
                        if with_ids:
                            pieces.append(part.astype(np.int32))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 5 + [pa.int32(), pa.int32(), pa.int64()]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                if with_ids:
                    arrays.append(pa.array(pieces, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(giving_back(run), schema)


def best_pattern(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack: how often to take each length so that the prices' sum is largest."""
    useful = np.flatnonzero(prices > 1e-12)
    counts = np.zeros(len(lengths), np.int64)
    if not len(useful):
        return 0.0, counts
    lens, values = lengths[useful], prices[useful]
    order = np.argsort(lens, kind="stable")
    useful, lens, values = useful[order], lens[order], values[order]
    fits = np.searchsorted(lens, np.arange(capacity + 1), "right")
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c], k = best[c - 1], -1
        if fits[c]:
            options = best[c - lens[: fits[c]]] + values[: fits[c]]
            k = int(options.argmax())
            if options[k] > best[c] + 1e-12:
                best[c], taken[c] = options[k], k
    c = capacity
    while c > 0:
        if taken[c] < 0:
            c -= 1
        else:
            counts[useful[taken[c]]] += 1
            c -= int(lens[taken[c]])
    return float(best[capacity]), counts


def cutting_stock(demand: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns {length: pieces in one sequence} with how often each is used; together they hold `demand` exactly.

    The simplex method on the master program starts from one pattern for each length. It ends when no pattern's
    reduced cost is negative, or after 30 pivots for each length, where the basis at hand is a feasible plan too.
    """
    lengths = np.array(sorted(k for k, n in demand.items() if n > 0), np.int64)
    if not len(lengths):
        return []
    wanted = np.array([demand[int(k)] for k in lengths], float)
    columns = np.diag(capacity // lengths).astype(float)
    inverse = np.diag(1 / np.diag(columns))
    x = inverse @ wanted
    for _ in range(30 * len(lengths)):
        value, pattern = best_pattern(lengths, inverse.sum(axis=0), capacity)
        if value <= 1 + 1e-7:
            break
        step = inverse @ pattern
        can = step > 1e-9
        ratio = np.where(can, x / np.where(can, step, 1), np.inf)
        leaves = int(ratio.argmin())
        theta = ratio[leaves]
        x = np.maximum(x - theta * step, 0)
        x[leaves] = theta
        row = inverse[leaves] / step[leaves]
        inverse -= np.outer(step, row)
        inverse[leaves] = row
        columns[:, leaves] = pattern
    columns = np.rint(columns).astype(np.int64)
    times = np.floor(x + 1e-6).astype(np.int64)
    left = wanted.astype(np.int64) - columns @ times
    for k in np.flatnonzero(left < 0):  # rounding noise of the basis: give up uses of a pattern until nothing is taken twice
        while left[k] < 0:
            p = int(np.flatnonzero((columns[k] > 0) & (times > 0))[0])
            times[p] -= 1
            left += columns[:, p]
    plan = [(dict(zip(lengths[c > 0].tolist(), c[c > 0].tolist(), strict=True)), int(t)) for c, t in zip(columns.T, times, strict=True) if t]
    while left.any():  # first fit decreasing; equal sequences are made together
        room, taken = capacity, np.zeros_like(left)
        for k in range(len(lengths) - 1, -1, -1):
            taken[k] = min(left[k], room // lengths[k])
            room -= taken[k] * lengths[k]
        used = taken > 0
        times_now = int((left[used] // taken[used]).min())
        plan.append((dict(zip(lengths[used].tolist(), taken[used].tolist(), strict=True)), times_now))
        left -= taken * times_now
    return plan


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = SEQUENCE, unit: int = UNIT, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    sequence_tokens (filled places) and sequence_length (with padding); with_ids adds the pieces' ids.

    Each id lies in exactly one piece; offsets in a sequence are gapless from 0. A sequence is padded to `capacity`
    unless it is filled to a power of two. A null or empty text is one piece of the end id. Rows with a null doc_id
    or a repeated one are documents of their own. Other columns are not looked at. An empty table gives no rows.
    """
    pieces = written(cut_pieces(docs, tokenizer_path, end_id, capacity, unit, with_ids), "pieces")
    counts = pieces.groupBy("class", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("class").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-counts")
    demand = {r["class"]: r["n"] for r in offsets.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    plan, first, places = cutting_stock(demand, capacity // unit), 0, {}
    for pattern, times in plan:
        for kind, each in pattern.items():
            taken, seqs, per = places.setdefault(kind, ([0], [], []))
            taken.append(taken[-1] + each * times)
            seqs.append(first)
            per.append(each)
        first += times
    places = {k: tuple(map(np.array, v)) for k, v in places.items()}

    def seat(kind: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.zeros(len(kind), np.int64)
        kinds, ranks = kind.to_numpy(), rank.to_numpy()
        for k in np.unique(kinds):
            at = np.flatnonzero(kinds == k)
            taken, seqs, per = places[int(k)]
            p = np.searchsorted(taken, ranks[at], "right") - 1
            out[at] = seqs[p] + (ranks[at] - taken[p]) // per[p]
        return pd.Series(out)

    seated = pieces.join(offsets.select("class", "task", "before"), ["class", "task"]).withColumn("rank", F.col("before") + F.col("place"))
    seated = seated.withColumn("sequence_id", F.pandas_udf(seat, "long")("class", "rank"))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "rank")
    filled = F.sum("length").over(Window.partitionBy("sequence_id"))
    return seated.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
        filled.alias("sequence_tokens"),
        F.when(F.bit_count(filled) == 1, filled).otherwise(F.lit(capacity).cast("long")).alias("sequence_length"),
        *(["ids"] if with_ids else []),
    )
