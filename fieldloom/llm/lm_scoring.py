"""Language-model scores by deleted interpolation of word bigrams, unigrams and a uniform distribution.

P(w | h) = l2(b) c(h, w) / c(h) + l1(b) c(w) / N + l0(b) / (V + 1), where the weights depend on b, the octave of the
context's count c(h). They are learned by expectation maximisation on held-out counts: a tenth of the training
documents is deleted from the counts, and the weights that make the deleted part most likely are kept; then all
training documents count. A word never seen has the uniform part alone.

Words are runs of bytes other than white space, A-Z lower-cased; each text ends with an end token, which also stands
before its first word: a word is a context as often as it is a token, so one table holds both counts. Words and bigrams are 64-bit hashes. How it is computed:

* documents are dealt into blocks of about `BLOCK` characters by their id; each block counts its own n-grams;
* the counts go to shards of the hash range as packed arrays, where they are summed;
* a shard tells each block which of its n-grams other blocks have too, with their totals (of all others the block has
  the totals itself), and its share of N and V;
* each block of texts meets its totals, once in a tenth of the blocks for the weights, once for the scores.

The driver sees a histogram of the held-out bigrams by probabilities in quarters of an octave, whose size has a fixed bound.
A null or empty text is an end token alone. Rows with a null doc_id train like others; repeated ids are documents of
their own. With no training document every word has P = 1. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_tables, mix, word_hashes, written

BLOCK = 16_000_000
HELD_OUT = 10
END = np.uint64(0x5851F42D4C957F2D)
BUCKETS = 40
STEPS = 4


def tokens_of(texts: pd.Series, tables: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of texts with their ends, and each text's bounds among them."""
    raw = [t.encode() for t in texts]
    words, sizes = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for a in range(0, len(raw), 512):
        part = raw[a : a + 512]
        starts = np.append(0, np.cumsum([len(t) for t in part]))
        data = np.frombuffer(b"".join(part), np.uint8)
        found, bounds = word_hashes(data, starts, tables) if len(data) else (np.empty(0, np.uint64), np.zeros(len(part) + 1, np.int64))
        words.append(np.insert(found, bounds[1:], END))
        sizes.append(np.diff(bounds) + 1)
    return np.concatenate(words), np.append(0, np.cumsum(np.concatenate(sizes)))


def pair_hash(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(context * np.uint64(0x9FB21C651E98DF25) + word)


def summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of each array of counts over them."""
    by = np.argsort(keys)
    keys = keys[by]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[first], *(np.add.reduceat(n[by], first) if len(first) else n for n in counts)


def pack_counts(counts: np.ndarray) -> bytes:
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype(np.int64).tobytes()


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data[n:], np.int64)
    return out


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences, byte planes apart, so that codecs find the small high bytes."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    gaps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T)
    return np.cumsum(gaps.view(np.uint64).ravel(), dtype=np.uint64)


def grouped(hashes: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in order, the sums of flags over them, and the place of each hash among them."""
    by = np.argsort(hashes)
    ordered = hashes[by]
    fresh = np.append(True, ordered[1:] != ordered[:-1])
    place = np.empty(len(hashes), np.int64)
    place[by] = np.cumsum(fresh) - 1
    first = np.flatnonzero(fresh)
    return ordered[first], np.add.reduceat(flags[by], first), place


class OwnCounts:
    """The n-grams of a block's texts in order, with their training counts there; kinds: 0 word, 1 bigram."""

    def __init__(self, texts: pd.DataFrame, n_shards: int):
        words, self.bounds = tokens_of(texts["text"], byte_tables())
        self.train = np.repeat(texts["train"].to_numpy(bool), np.diff(self.bounds))
        flags = self.train.astype(np.int64)
        contexts = np.append(END, words[:-1])  # before a text's first word stands the end of the one before
        self.counts, self.places, self.cuts = [], [], []
        for hashes in (words, pair_hash(contexts, words)):
            keys, n, place = grouped(hashes, flags)
            self.counts.append((keys, n))
            self.places.append(place)
            shards = (keys >> np.uint64(32)) * np.uint64(n_shards) >> np.uint64(32)
            self.cuts.append(np.searchsorted(shards, np.arange(n_shards + 1, dtype=np.uint64)))
        self.context = np.append(self.places[0][-1], self.places[0][:-1])


def count_blocks(blocks: DataFrame, n_shards: int) -> DataFrame:
    """(shard, block, kind, keys, counts) for each block, shard and kind."""

    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        own, rows = OwnCounts(group, n_shards), []
        for kind, ((keys, n), cuts) in enumerate(zip(own.counts, own.cuts, strict=True)):
            rows += [(s, key[0], kind, pack_keys(keys[i:j]), pack_counts(n[i:j])) for s, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
        return pd.DataFrame(rows, columns=["shard", "block", "kind", "keys", "counts"])

    return blocks.groupBy("block").applyInPandas(run, "shard int, block int, kind int, keys binary, counts binary")


def total_up(counts: DataFrame) -> DataFrame:
    """For each block, shard and kind: which of the block's n-grams others have (bits), their totals in all blocks and
    in held-out blocks, and the shard's number of tokens and of distinct n-grams in training, and of tokens kept."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for kind, part in group.groupby("kind"):
            each = [unpack_keys(k) for k in part["keys"]]
            sizes = [len(k) for k in each]
            n = np.concatenate([unpack_counts(c, size) for c, size in zip(part["counts"], sizes, strict=True)])
            flat, blocks = np.concatenate(each), part["block"].to_numpy()
            held_row = np.repeat(blocks % HELD_OUT == 0, sizes)
            keys, totals, held, spread = summed(flat, n, np.where(held_row, n, 0), np.ones(len(flat), np.int64))
            for block, k in zip(blocks, each, strict=True):
                at = np.searchsorted(keys, k)
                more = spread[at] > 1
                at = at[more]
                rows.append((int(block), int(group["shard"].iloc[0]), int(kind), np.packbits(more).tobytes(), pack_counts(totals[at]), pack_counts(held[at]),
                             int(totals.sum()), int((totals > 0).sum()), int(totals.sum() - held.sum())))
        return pd.DataFrame(rows, columns=["block", "shard", "kind", "shared", "totals", "held", "n", "v", "kept"])

    schema = "block int, shard int, kind int, shared binary, totals binary, held binary, n long, v long, kept long"
    return counts.groupBy("shard").applyInPandas(run, schema)


class BlockModel(OwnCounts):
    """A block's counts after the shards' answers: of all training documents, and of those not held out."""

    def __init__(self, block: int, texts: pd.DataFrame, given: pd.DataFrame, n_shards: int):
        super().__init__(texts, n_shards)
        self.held = [n.copy() if block % HELD_OUT == 0 else np.zeros_like(n) for _, n in self.counts]
        for shard, kind, shared, totals, held in given[["shard", "kind", "shared", "totals", "held"]].itertuples(index=False):
            i, j = self.cuts[kind][shard : shard + 2]
            at = i + np.flatnonzero(np.unpackbits(np.frombuffer(shared, np.uint8), count=j - i))
            self.counts[kind][1][at] = unpack_counts(totals, len(at))
            self.held[kind][at] = unpack_counts(held, len(at))
        words = given[given["kind"] == 0]
        self.n, self.v, self.kept = (int(words[c].sum()) for c in ("n", "v", "kept"))

    def of(self, kind: int, kept: bool, place: np.ndarray | None = None) -> np.ndarray:
        n = self.counts[kind][1]
        return (n - self.held[kind] if kept else n)[self.places[kind] if place is None else place]

    def parts(self, kept: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token the octave of its context, and its bigram's and word's probability times V + 1."""
        h, w, hw = self.of(0, kept, self.context), self.of(0, kept), self.of(1, kept)
        octave = np.minimum(np.ceil(np.log2(h + 1)).astype(np.int64), BUCKETS - 1)
        n = self.kept if kept else self.n
        return octave, hw / np.maximum(h, 1) * (self.v + 1), w / max(n, 1) * (self.v + 1)


def steps(ratio: np.ndarray) -> np.ndarray:
    return np.where(ratio > 0, np.rint(STEPS * np.log2(np.maximum(ratio, 1e-300))), -32768).astype(np.int64)


def learn_weights(held: pd.DataFrame, rounds: int = 100) -> np.ndarray:
    """Weights (octave; bigram, word, uniform) from (octave, pair, word, n), by EM; each part has one token to start with."""
    weights = np.tile([0.4, 0.4, 0.2], (BUCKETS, 1))
    weights[0] = [0, 0.8, 0.2]
    for octave, part in held.groupby("octave"):
        ratios = [np.where(part[c] > -32768, 2.0 ** (part[c].clip(lower=-4096) / STEPS), 0.0) for c in ("pair", "word")]
        ratios, n = np.stack([*ratios, np.ones(len(part))], axis=1), part["n"].to_numpy(float)
        x = weights[octave]
        for _ in range(rounds):
            parts = ratios * x
            x = (parts / parts.sum(axis=1, keepdims=True) * n[:, None]).sum(axis=0) + weights[octave]
            x = x / x.sum()
        weights[octave] = x
    return weights


def score_texts(docs: DataFrame, train: Column, block_bytes: int = BLOCK) -> DataFrame:
    """doc_id, held_out (not in training), n_tokens, n_known, train_tokens, base_score (add-one unigrams), score."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(HELD_OUT, -(-int(size) // block_bytes))
    blocks = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(n_blocks)).cast("int"))
    given = written(total_up(count_blocks(blocks, n_blocks)), "ngram-totals")

    def held_out(key, texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        model = BlockModel(key[0], texts, answers, n_blocks)
        octave, pair, word = (x[model.train] for x in model.parts(True))
        rows = pd.DataFrame({"octave": octave, "pair": steps(pair), "word": steps(word)})
        return rows.groupby(["octave", "pair", "word"]).size().reset_index(name="n")

    tenth = (df.where(F.col("block") % HELD_OUT == 0).groupBy("block") for df in (blocks, given))
    seen = next(tenth).cogroup(next(tenth)).applyInPandas(held_out, "octave long, pair long, word long, n long")
    weights = learn_weights(seen.groupBy("octave", "pair", "word").agg(F.sum("n").alias("n")).toPandas())

    def score(key, texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        model = BlockModel(key[0], texts, answers, n_blocks)
        octave, pair, word = model.parts(False)
        x = weights[octave] if model.n else np.tile([0.0, 0.0, 1.0], (len(octave), 1))
        logs = np.log10((x[:, 0] * pair + x[:, 1] * word + x[:, 2]) / (model.v + 1))
        count = model.of(0, False)
        base = np.log10((count + 1) / (model.n + (model.v + 1)))
        first = model.bounds[:-1]
        return pd.DataFrame({
            "doc_id": texts["doc_id"], "held_out": ~texts["train"].to_numpy(bool), "n_tokens": np.diff(model.bounds),
            "n_known": np.add.reduceat((count > 0).astype(np.int64), first), "train_tokens": model.n,
            "base_score": np.add.reduceat(base, first), "score": np.add.reduceat(logs, first),
        })

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.groupBy("block").cogroup(given.groupBy("block")).applyInPandas(score, schema)
