"""Ranked lexical search by variable-block-max WAND.

Terms are the longest runs of ASCII letters and digits and of all code points from U+0080 on; A-Z count as a-z, else
terms are taken as they stand. A document's score for an item is the sum over the item's terms, repeats included, of
weight * ((1000000000 * tf) div (1000 * tf + 8 * m)) with m = 25 + ((75 * n * N) div L), in 64-bit whole numbers;
a term's weight is floor(1000 * ln((2 * N + 2) / (2 * df + 1))). N counts the documents with a term, L all their terms,
n a document's, df the documents that hold the term.

1. A task reads documents into shards of about `shard_postings` postings and writes the posting lists of the terms that
   are asked for, one row for each shard and term.
2. N, L and df are sums over those rows.
3. In each shard the lists are cut into blocks of different lengths. Dynamic programming finds the cuts for which the
   blocks' maxima exceed their postings' scores by the least in total, each block costing `BLOCK_COST` mean scores.
4. For each item the blocks' ends divide the shard's documents into ranges, over each of which the sum of the maxima of
   the blocks there bounds every score. Ranges are taken by falling bound and only their blocks are read; of the lists
   that are too weak to reach the kth score so far, even together, only blocks that hold a document of the others. The
   search ends when no bound reaches the kth score. The shards' best meet in a window with a limit in front of it.

Results are exact. Terms are compared by 64-bit hashes: that any of T asked terms meets another of V corpus terms has a
chance of about T * V / 2**64. Items go in slices of at most `slice_bytes` of text, each a pass over the documents, so
that their terms fit into a broadcast. An item id that repeats asks once, with its largest text; items without an id or
a term ask nothing. Null and empty texts have no terms. Rows of `docs` count one by one, repeated ids included; those
without a doc_id count in N, L and df but are not returned. Ties go to the smaller doc_id. Other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_tables, text_chunks, word_hashes, written

SHARD_POSTINGS = 1 << 21
#: Lists are cut at every so many postings, and within them by dynamic programming into blocks up to a length.
RUN = 256
LONGEST_BLOCK = 64
BLOCK_COST = 12.0
DOCS = -1


def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As common.byte_tables, but all of ASCII except letters and digits ends a term."""
    value, space, powers = byte_tables()
    space[:128] = [not chr(c).isalnum() for c in range(128)]
    space[128:] = False
    return value, space, powers


def terms_of(texts: list[str]) -> list[np.ndarray]:
    """The hashes of each text's terms, in order."""
    known, out = tables(), []
    for _, _, data, starts in text_chunks(pa.array(texts, pa.string())):
        h, bounds = word_hashes(data, starts, known)
        out += [h[i:j] for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return out


def posting_lists(docs: DataFrame, vocabulary: np.ndarray, shard_postings: int) -> DataFrame:
    """(shard, term, n, docs, counts, n_docs, n_terms): a list's documents (places in the shard) and counts as bytes, and
    for each shard a row of term `DOCS` with its documents' ids and sizes (below 0 where the id is null), and how many have a term, and how many those are."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    names = ["shard", "term", "n", "docs", "counts", "n_docs", "n_terms"]

    def rows_of(shard, ids, sizes, keys, counts, n_docs, n_terms, n_vocabulary):
        ids, sizes = np.concatenate(ids), np.concatenate(sizes)
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(keys % n_vocabulary, kind="stable")  # by term, then by document
        keys, counts = keys[order], counts[order]
        term, place = keys % n_vocabulary, (keys // n_vocabulary).astype(np.uint32)
        first = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.empty(0, np.int64)
        ends = np.append(first[1:], len(term))
        lists = [[a[i:j].tobytes() for i, j in zip(first.tolist(), ends.tolist(), strict=True)] for a in (place, counts.astype(np.uint32))]
        zeros = [0] * len(first)
        arrays = [
            pa.array([shard] * (len(first) + 1), pa.int64()), pa.array([*term[first].tolist(), DOCS], pa.int32()),
            pa.array([*(ends - first).tolist(), len(ids)], pa.int64()), pa.array([*lists[0], ids.tobytes()], pa.binary()),
            pa.array([*lists[1], sizes.tobytes()], pa.binary()), pa.array([*zeros, n_docs], pa.int64()), pa.array([*zeros, n_terms], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches):
        vocabulary, known, n_shards = shared.value, tables(), 0
        base = TaskContext.get().partitionId() << 24
        held, n_held, n_docs, n_terms, n_places = ([], [], [], []), 0, 0, 0, 0
        for batch in batches:
            doc_ids = batch.column("doc_id")
            valid = np.asarray(doc_ids.is_valid())
            doc_ids = doc_ids.fill_null(0).to_numpy()
            for a, b, data, starts in text_chunks(batch.column("text")):
                h, bounds = word_hashes(data, starts, known)
                sizes = np.diff(bounds)
                n_docs, n_terms = n_docs + int((sizes > 0).sum()), n_terms + int(sizes.sum())
                at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                asked = vocabulary[at] == h
                doc = np.repeat(np.arange(b - a), sizes)[asked]
                keys, counts = np.unique(doc * len(vocabulary) + at[asked], return_counts=True)
                own = np.unique(keys // len(vocabulary))  # only documents with a posting have a place
                place = n_places + np.searchsorted(own, keys // len(vocabulary))
                for x, y in zip(held, (doc_ids[a:b][own], np.where(valid[a:b], sizes, -sizes)[own], place * len(vocabulary) + keys % len(vocabulary), counts), strict=True):
                    x.append(y)
                n_held, n_places = n_held + len(keys), n_places + len(own)
                if n_held >= shard_postings:
                    yield rows_of(base + n_shards, *held, n_docs, n_terms, len(vocabulary))
                    held, n_held, n_docs, n_terms, n_places, n_shards = ([], [], [], []), 0, 0, 0, 0, n_shards + 1
        if n_docs:
            yield rows_of(base + n_shards, *held, n_docs, n_terms, len(vocabulary))

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "shard long, term int, n long, docs binary, counts binary, n_docs long, n_terms long")


def block_starts(scores: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the blocks of lists begin that lie one after another, the lists' own starts included.

    A block of b postings costs b times its maximum and `BLOCK_COST` mean scores of its list; the best cuts of the first
    i postings of a run follow from those of the up to `LONGEST_BLOCK` places before. All runs go forward together.
    """
    sizes = np.diff(starts)
    mean = np.add.reduceat(scores.astype(float), starts[:-1]) / sizes if len(sizes) else np.empty(0)
    n_runs = -(-sizes // RUN)
    of_list = np.repeat(np.arange(len(sizes)), n_runs)
    begin = starts[of_list] + RUN * (np.arange(len(of_list)) - np.repeat(np.cumsum(n_runs) - n_runs, n_runs))
    length = np.minimum(RUN, starts[of_list + 1] - begin)
    cost_of = BLOCK_COST * mean[of_list]
    order, out = np.argsort(-length, kind="stable"), [begin]
    reach = np.arange(1, LONGEST_BLOCK + 1, dtype=float)
    for a in range(0, len(order), 512):
        runs = order[a : a + 512]
        most, rows = int(length[runs[0]]), np.arange(len(runs))
        x = scores[np.minimum(begin[runs, None] + np.arange(most), len(scores) - 1)].astype(float)
        cost, taken = np.zeros((len(runs), most + 1)), np.zeros((len(runs), most + 1), np.int64)
        highest = np.zeros((len(runs), LONGEST_BLOCK))  # of the last 1, 2, ... postings
        for i in range(1, most + 1):
            width = min(i, LONGEST_BLOCK)
            highest[:, 1:width] = np.maximum(highest[:, : width - 1], x[:, i - 1 : i])
            highest[:, 0] = x[:, i - 1]
            total = highest[:, :width] * reach[:width] + cost[:, i - width : i][:, ::-1]
            best = total.argmin(axis=1)
            cost[:, i], taken[:, i] = total[rows, best] + cost_of[runs], best + 1
        at = length[runs].copy()
        while len(rows):
            at[rows] -= taken[rows, at[rows]]
            rows = rows[at[rows] > 0]
            out.append(begin[runs[rows]] + at[rows])
    return np.unique(np.concatenate(out))


class Shard:
    """The posting lists of one shard, scored and cut into blocks."""

    def __init__(self, doc_ids, sizes, terms, places, counts, starts, weights, n_docs: int, n_terms: int):
        self.doc_ids, self.lists, self.places = doc_ids, {t: k for k, t in enumerate(terms.tolist())}, places
        m = 25 + (75 * np.abs(sizes) * n_docs) // n_terms
        self.scores = (sizes > 0)[places] * np.repeat(weights[terms], np.diff(starts)) * ((1_000_000_000 * counts) // (1000 * counts + 8 * m[places]))
        self.begin = block_starts(self.scores, starts)
        self.end = np.append(self.begin[1:], len(places))
        self.most = np.maximum.reduceat(self.scores, self.begin) if len(self.begin) else np.empty(0, np.int64)
        self.blocks = np.searchsorted(self.begin, starts)  # of each list
        self.read = 0  # postings, for measuring

    def postings(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the blocks' postings in the lists, and how many each block has."""
        sizes = (self.end - self.begin)[blocks]
        at = np.repeat(self.begin[blocks] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        self.read += len(at)
        return at, sizes

    def best(self, terms: np.ndarray, repeats: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(doc_ids, scores) of the k best for an item's terms."""
        lists = [(self.lists[t], r) for t, r in zip(terms.tolist(), repeats.tolist(), strict=True) if t in self.lists]
        if not lists:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        blocks = np.concatenate([np.arange(self.blocks[t], self.blocks[t + 1]) for t, _ in lists])
        n_blocks = np.array([self.blocks[t + 1] - self.blocks[t] for t, _ in lists])
        times = np.repeat([r for _, r in lists], n_blocks)
        most = times * self.most[blocks]
        low, high = self.places[self.begin[blocks]], self.places[self.end[blocks] - 1] + 1
        edges, where = np.unique(np.concatenate([low, high]), return_inverse=True)
        change = np.zeros(len(edges), np.int64)
        np.add.at(change, where, np.concatenate([most, -most]))
        bounds = np.cumsum(change)[:-1]
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        of_list = np.maximum.reduceat(most, np.cumsum(n_blocks) - n_blocks)
        weakest = np.argsort(of_list, kind="stable")
        together = np.empty(len(lists), np.int64)  # the most that a list and all weaker ones can give
        together[weakest] = np.cumsum(of_list[weakest])
        together = np.repeat(together, n_blocks)
        ids, scores, kth, done, step = np.empty(0, np.int64), np.empty(0, np.int64), 0, 0, 16
        while done < len(order) and bounds[order[done]] >= max(kth, 1):
            part = order[done : done + step]
            part = part[bounds[part] >= kth]
            done, step = done + step, step * 4
            wanted = np.zeros(len(edges) + 1, np.int64)  # ranges, then how many of them come before each edge
            wanted[part + 1] = 1
            upto = np.cumsum(wanted)
            open_ = upto[where[len(blocks) :]] > upto[where[: len(blocks)]]
            # documents of weak lists alone stay below the kth score: the others' lists name all that can matter
            strong = np.flatnonzero(open_ & (together >= kth))
            at, sizes = self.postings(blocks[strong])
            inside = wanted[np.searchsorted(edges, self.places[at], "right")] == 1
            docs, to = np.unique(self.places[at[inside]], return_inverse=True)
            found = np.zeros(len(docs), np.int64)
            np.add.at(found, to, (self.scores[at] * np.repeat(times[strong], sizes))[inside])
            weak = np.flatnonzero(open_ & (together < kth))
            weak = weak[np.searchsorted(docs, high[weak]) > np.searchsorted(docs, low[weak])]
            if len(weak):
                at, sizes = self.postings(blocks[weak])
                to = np.minimum(np.searchsorted(docs, self.places[at]), len(docs) - 1)
                same = docs[to] == self.places[at]
                np.add.at(found, to[same], (self.scores[at] * np.repeat(times[weak], sizes))[same])
            docs, found = docs[found > 0], found[found > 0]
            ids, scores = np.append(ids, self.doc_ids[docs]), np.append(scores, found)
            top = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[top], scores[top]
            kth = int(scores[-1]) if len(scores) == k else 0
        return ids, scores


def shard_of(rows: pa.Table, weights: np.ndarray, n_docs: int, n_terms: int) -> Shard:
    rows = rows.sort_by("term")  # the row of the documents comes first
    docs, counts = rows.column("docs").to_pylist(), rows.column("counts").to_pylist()
    starts = np.append(0, np.cumsum(rows.column("n").to_numpy()[1:]))
    places, n = (np.frombuffer(b"".join(x[1:]), np.uint32).astype(np.int64) for x in (docs, counts))
    return Shard(np.frombuffer(docs[0], np.int64), np.frombuffer(counts[0], np.int64), rows.column("term").to_numpy()[1:], places, n, starts, weights, n_docs, n_terms)


def search(docs: DataFrame, items: DataFrame, k: int = 10, shard_postings: int = SHARD_POSTINGS, slice_bytes: int = 1 << 22) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents with a score above 0 of each item."""
    items = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where(F.col("item_id").isNotNull() & (F.length("text") > 0))
    items = items.groupBy("item_id").agg(F.max("text").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_slices, found = max(1, -(-int(size) // slice_bytes)), None
    for s in range(n_slices):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n_slices)) == s).orderBy("item_id").collect()
        some = search_slice(docs, [r["item_id"] for r in part], [r["text"] for r in part], k, shard_postings)
        found = some if found is None else found.unionByName(some)
    first = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search_slice(docs: DataFrame, item_ids: list[int], texts: list[str], k: int, shard_postings: int) -> DataFrame:
    """(item_id, doc_id, score): the best of each shard."""
    spark = docs.sparkSession
    hashes = terms_of(texts)
    vocabulary = np.unique(np.concatenate([*hashes, np.empty(0, np.uint64)]))
    kind = "item_id long, doc_id long, score long"
    if not len(vocabulary):
        return spark.createDataFrame([], kind)
    asked = [(i, *np.unique(np.searchsorted(vocabulary, h), return_counts=True)) for i, h in zip(item_ids, hashes, strict=True)]
    lists = written(posting_lists(docs, vocabulary, shard_postings), "postings")
    n_docs, n_terms = (int(x or 0) for x in lists.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    weights = np.zeros(len(vocabulary), np.int64)
    for term, df in lists.where(F.col("term") != DOCS).groupBy("term").agg(F.sum("n").alias("df")).toLocalIterator():  # of the slice's terms
        weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    shared = spark.sparkContext.broadcast((asked, weights))

    def run(rows: pa.Table) -> pa.Table:
        asked, weights = shared.value
        shard = shard_of(rows, weights, n_docs, n_terms)
        found = [(i, *shard.best(terms, repeats, k)) for i, terms, repeats in asked]
        columns = [np.concatenate([np.full(len(d), i, np.int64) for i, d, _ in found]), *(np.concatenate([f[c] for f in found]) for c in (1, 2))]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item_id", "doc_id", "score"])

    return lists.select("shard", "term", "n", "docs", "counts").groupBy("shard").applyInArrow(run, kind)
