"""Near-duplicate detection by order MinHash, verified by banded alignment.

A document is its sequence of words (white space parts them, A-Z lower-cased). Each run of five words is labelled
with how often it came before in the document. For each of `SKETCHES` random orders, the `DEPTH` smallest labelled
runs are kept in their order in the text, and hashed: two texts agree in such a sketch with a chance of about their
runs' Jaccard similarity to the power DEPTH, less where the order differs. One agreement makes a candidate pair.
Texts of up to `SHORT` words are sketched by runs of three words, as scattered edits leave few runs of five in them;
those long enough to match a longer one by runs of five as well.

Candidates are verified by edit distance over words: 1 - distance / longer length must reach `SIMILARITY`. Pairs that
have too few words in common for that are put aside first: within buckets by bitmaps of `BITS` bits, in which an edit
changes two bits at most (this tells texts of up to some 500 words apart), then by small tables of their words' counts.
Neither loses a pair that would be verified; the others' texts are aligned in a band.

Texts of up to `TINY` words, and all that are short enough to match one, are bucketed by their subsequences too: a
text of n words and a shorter one within e = (1 - SIMILARITY) * n edits have a subsequence of n - e words in common,
so no such pair is missed.

Exact copies are one class from the start and only the smallest id of them goes on. Texts with one sketch are a
bucket. Every text is compared with the smallest id of the buckets that it shares with that one most often, which joins
most copies. From then on only texts of different classes are compared: each with its other buckets' smallest ids, and
in buckets of up to `PAIRWISE` members any two. Larger ones (a passage that many texts quote) are split, first without
loss: two similar texts of which one has n words share all but (1 - SIMILARITY) * n of these, labelled with how often
they came before, so each lists its rarest ones, one more than it may lose, and they have a listed word in common. Texts
that list one word are a part. In parts of more than `PAIRWISE` members each is compared with two of them, chosen by
hash; then members of different classes are compared throughout, those of large parts in blocks, inside tasks: no pair
becomes a row but those that join classes (see `links_in_parts`). Parts of more than `SPLIT` members for each word that their lists have left are first split by a second
word in common, and a third (lists are longer by one for each; any order of words that all texts go by would do). Parts
of the last round are blocks at any size; their members first meet the leaders of parts by deeper sketches of the same
order, of `DEEPER` runs, which joins most copies. So no two texts of one bucket miss each other.

Texts without a word (null, empty, blank) stand alone. A class is named by its smallest doc_id. Rows with one doc_id
are one document, whose text is the longest of them (of these the one of the largest hash, see `text_rank`); rows with
a null doc_id have no class and are left out. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import byte_tables, giving_back, mix, slices, small_batches, text_chunks, word_hashes, written

RUN = 5
SHORT, SHORT_RUN = 75, 3
TINY = 10
SKETCHES = 80
DEPTH = 2
DEEPER = (4, 12)
SIMILARITY = 0.8
PAIRWISE = 64
BROADCAST = 1_000_000
BITS = 512
ROUNDS = 3  # of splits by rare words
SPLIT = 200  # a row of a split costs about as much as this many comparisons in a block
BLOCK, BLOCK_WORDS = 512, 1 << 22  # members of a block, and their words
FIRST = 8  # of a text's parts, by which a pair is known to meet elsewhere
DECK = 8_000  # members of small parts that are compared together
BINS = 1 << 16  # in which words are counted, to tell rare ones
ROWS = 5_000  # texts for each partition of the small tables that the rounds write


def runs_of(words: np.ndarray, size: int) -> np.ndarray:
    h = words[: len(words) - size + 1].copy()
    for k in range(1, size):
        h = h * np.uint64(0x2545F4914F6CDD1D) + words[k : len(words) - size + 1 + k]
    return mix(h + np.uint64(size))


def orders() -> np.ndarray:
    """An odd factor for each order: hashes of runs are ordered by their products with it."""
    return (np.random.default_rng(20240301).integers(0, 2**31, SKETCHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]


def smallest(words: np.ndarray, orders: np.ndarray, size: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of `size` words, and in each order the places of the `depth` smallest labelled ones, smallest first."""
    runs = runs_of(words, size)
    n = len(runs)
    by = np.argsort(runs, kind="stable")
    same = runs[by]
    fresh = np.append(True, same[1:] != same[:-1])
    times = np.arange(n) - np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    label = np.empty(n, np.uint64)
    label[by] = times.astype(np.uint64)
    h = (mix(runs + label * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)[None, :] * orders
    few = 6 * depth
    if n > 4 * few:  # only small values can be among the smallest
        place = np.flatnonzero(h.ravel() < np.uint32(2**32 * few / n))
        row = place // n
        sizes = np.bincount(row, minlength=len(h))
        if sizes.min() >= depth:
            place = place[np.argsort(row.astype(np.uint64) << np.uint64(32) | h.ravel()[place])]
            starts = np.cumsum(sizes) - sizes
            return runs, place[starts[:, None] + np.arange(depth)] % n
    return runs, np.argsort(h, axis=1, kind="stable")[:, :depth]


def hashed_in_order(runs: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each order one hash of its runs as they follow each other in the text."""
    kept = runs[np.sort(places, axis=1)]
    out = np.arange(len(places), dtype=np.uint64)
    for k in range(places.shape[1]):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + kept[:, k])
    return out.view(np.int64)


def run_sizes(n: int) -> list[int]:
    """The sizes of the runs by which a text of n words is sketched."""
    sizes = [SHORT_RUN] if n <= SHORT else []
    return sizes + [RUN] * (n >= SIMILARITY * SHORT)


def sketches(words: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """The order MinHash sketches; none for a text of fewer than DEPTH runs."""
    found = [hashed_in_order(*smallest(words, orders, size, DEPTH)) for size in run_sizes(len(words)) if len(words) - size + 1 >= DEPTH]
    return np.concatenate(found) if found else np.empty(0, np.int64)


def deeper_sketches(words: np.ndarray, orders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sketches, and for each of them those of the DEEPER runs (of all runs, where there are fewer)."""
    keys, parts = [np.empty(0, np.int64)], [np.empty((0, len(DEEPER)), np.int64)]
    for size in run_sizes(len(words)):
        n = len(words) - size + 1
        if n >= DEPTH:
            runs, places = smallest(words, orders, size, min(n, DEEPER[-1]))
            keys.append(hashed_in_order(runs, places[:, :DEPTH]))
            parts.append(np.stack([hashed_in_order(runs, places[:, :depth]) for depth in DEEPER], axis=1))
    return np.concatenate(keys), np.concatenate(parts)


def edit_limit(n: int, similarity: float) -> int:
    """The edits that a pair may have whose longer text has n words."""
    return int((1 - similarity) * n + 1e-9)


def short_lengths(similarity: float) -> tuple[int, set[int]]:
    """The words of the longest text that can match a tiny one, and the lengths of subsequences needed."""
    longest = max(n for n in range(TINY, 2 * int(TINY / similarity) + 2) if n - edit_limit(n, similarity) <= TINY)
    return longest, {n - edit_limit(n, similarity) for n in range(1, longest + 1) if edit_limit(n, similarity)}


def subsequences(words: np.ndarray, similarity: float, lengths: tuple[int, set[int]]) -> np.ndarray:
    """Hashes of the subsequences that a short text and another within its edits have in common."""
    n, (longest, wanted) = len(words), lengths
    out = []
    for size in wanted if 0 < n <= longest else ():
        if n - edit_limit(n, similarity) <= size <= n:
            kept = words[np.array(list(combinations(range(n), size)))]
            h = np.full(len(kept), size, np.uint64)
            for k in range(size):
                h = mix(h * np.uint64(0xD6E8FEB86659FD93) + kept[:, k])
            out.append(h)
    return np.unique(np.concatenate(out)).view(np.int64) if out else np.empty(0, np.int64)


def text_rank(text: str) -> F.Column:
    """By this the largest of several texts of one doc_id stands for the document."""
    text = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return F.struct(F.octet_length(text).alias("size"), F.xxhash64(text).alias("hash"))


def bag_of(words: np.ndarray) -> bytes:
    """How many of a text's words fall in each of about half as many bins, at most 15, in half a byte; and before
    that, how many words the bins couldn't count."""
    bins = 1 << max(4, int(np.ceil(np.log2(max(1, len(words)) / 2))))
    n = np.bincount((words >> np.uint64(32)).astype(np.int64) & (bins - 1), minlength=bins)
    kept = np.minimum(n, 15).astype(np.uint8)
    return np.uint32(n.sum() - kept.sum()).tobytes() + (kept[: bins // 2] | kept[bins // 2 :] << 4).tobytes()


def labelled_words(words: np.ndarray) -> np.ndarray:
    """The words, each labelled with how often it came before, as hashes in no order."""
    n = len(words)
    w = np.sort(words)
    fresh = np.append(True, w[1:] != w[:-1])[:n]
    times = np.arange(n) - np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    return mix(w + times.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def bitmap_of(words: np.ndarray) -> np.ndarray:
    """A bit for each labelled word, in `BITS` bits as signed 64-bit numbers."""
    at = labelled_words(words) % np.uint64(BITS)
    bits = np.zeros(BITS, np.uint8)
    bits[at.astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def few_bits_differ(one: str, other: str, n_one: str, n_other: str, similarity: float) -> F.Column:
    """Whether two texts' bitmaps allow their similarity: an edit changes one labelled word, or takes one for another."""
    bits = sum((F.bit_count(F.col(one)[k].bitwiseXOR(F.col(other)[k])) for k in range(1, BITS // 64)), F.bit_count(F.col(one)[0].bitwiseXOR(F.col(other)[0])))
    return bits <= 2 * F.floor((1 - similarity) * F.greatest(n_one, n_other) + 1e-9)


def common_at_most(x: bytes, y: bytes) -> int:
    """A bound on the words that two texts have in common, from their bags."""
    rest, bins = [], []
    for bag in (x, y):
        rest.append(int(np.frombuffer(bag, np.uint32, 1)[0]))
        half = np.frombuffer(bag, np.uint8, offset=4)
        bins.append(np.concatenate([half & 15, half >> 4]))
    alone = len(bins[0]) == len(bins[1])
    while len(bins[0]) != len(bins[1]):
        k = len(bins[0]) < len(bins[1])
        bins[k] = bins[k][: len(bins[k]) // 2] + bins[k][len(bins[k]) // 2 :]
    return int(np.minimum(*bins).sum()) + (min(rest) if alone else sum(rest))


def views(column: pa.Array):
    """The values of a binary column without nulls, one after another and without copies."""
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1].tolist() if len(column) else []
    data = memoryview(column.buffers()[2] or b"")
    return (data[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True))


def promising(pairs: DataFrame, bags: DataFrame, similarity: float, few) -> DataFrame:
    """The pairs (a, b) that may have enough words in common, by their bags (doc_id, n_words, bag)."""
    both = pairs
    for end in "ba":
        both = both.join(bags.select(F.col("doc_id").alias(end), F.col("n_words").alias(f"n_{end}"), F.col("bag").alias(f"bag_{end}")), end)

    def run(batches):
        for batch in batches:
            kept = []
            bags, sizes = [views(batch.column(c)) for c in ("bag_a", "bag_b")], [batch.column(c).to_pylist() for c in ("n_a", "n_b")]
            for k, (x, y, n, m) in enumerate(zip(*bags, *sizes, strict=True)):
                n = max(n, m)
                if common_at_most(x, y) >= n - edit_limit(n, similarity):
                    kept.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(kept, pa.int64())) for c in ("a", "b")], names=["a", "b"])

    both = both.select("a", "b", "n_a", "n_b", "bag_a", "bag_b")
    return few(both).mapInArrow(giving_back(run), "a long, b long")


def profiles(docs: DataFrame, similarity: float) -> DataFrame:
    """doc_id, rank, n_words, h1, h2 (of the sequence of words), bag, bits, sketches (and tiny texts' subsequences)."""

    def run(batches):
        tables, shuffles, lengths = byte_tables(), orders(), short_lengths(similarity)
        powers = np.ones(1, np.uint64)
        for batch in slices(batches):
            n, h1, h2, bags, bits, marks = [], [], [], [], [], []
            for _, _, data, starts in text_chunks(batch.column("text")):
                words, bounds = word_hashes(data, starts, tables)
                for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    w = words[i:j]
                    if len(w) > len(powers):
                        powers = np.cumprod(np.full(2 * len(w), 0xDA942042E4DD58B5, np.uint64), dtype=np.uint64)
                    n.append(len(w))
                    h1.append(int((w * powers[: len(w)]).sum().view(np.int64)))
                    h2.append(int((mix(w) * powers[: len(w)]).sum().view(np.int64)))
                    bags.append(bag_of(w))
                    bits.append(bitmap_of(w))
                    marks.append(np.append(sketches(w, shuffles), subsequences(w, similarity, lengths)))
            arrays = [batch.column("doc_id"), batch.column("rank"), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(bags, pa.binary()), pa.array(bits, pa.list_(pa.int64())), pa.array(marks, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "rank", "n_words", "h1", "h2", "bag", "bits", "sketches"])

    rank = "rank struct<size: int, hash: bigint>"
    return docs.select("doc_id", "text", text_rank("text").alias("rank")).mapInArrow(giving_back(run), f"doc_id long, {rank}, n_words long, h1 long, h2 long, bag binary, bits array<long>, sketches array<long>")


def edits_within(a: list[int], b: list[int], most: int) -> int | None:
    """The edit distance of two sequences if it is at most `most`: bit-parallel, in a band of 2 * most + 1 diagonals."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return None
    k = 0
    while k < len(b) and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    k = 0
    while k < len(b) and a[-1 - k] == b[-1 - k]:
        k += 1
    a, b = a[: len(a) - k], b[: len(b) - k]
    if not b or most >= len(a):
        most = min(most, len(a))
    if not b:
        return len(a) if len(a) <= most else None
    # column j of the table is b's j-th item; the band's lowest bit is row j - most of a, its height 2 * most + 1
    width = 2 * most + 1
    full, middle = (1 << width) - 1, 1 << most
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << (i + most)  # bit of row i in the band of column i
    plus, minus = full ^ ((1 << most) - 1), 0  # row differences of column 0: rows below the first grow by one
    score = 0
    for j, y in enumerate(b):
        eq = (where.get(y, 0) >> j) & full
        d = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        hp = (minus | ~(d | plus)) & full
        hm = d & plus
        score += not d & middle  # along the main diagonal a step costs one unless the cells agree
        shifted = d >> 1
        plus = (hm | ~(shifted | hp)) & full
        minus = shifted & hp
        if score > 2 * most:
            return None
    # down the last column from the main diagonal to the last row
    for i in range(len(a) - len(b)):
        bit = 1 << (most + i)
        score += bool(plus & bit) - bool(minus & bit)
    return score if score <= most else None


def words_in_common(x: np.ndarray, y: np.ndarray) -> int:
    """The size of the common part of two bags of words."""
    _, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    n = at.max() + 1
    return int(np.minimum(np.bincount(at[: len(x)], minlength=n), np.bincount(at[len(x) :], minlength=n)).sum())


def alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    n = max(len(x), len(y))
    most = edit_limit(n, similarity)
    return words_in_common(x, y) >= n - most and edits_within(x.tolist(), y.tolist(), most) is not None


def as_is(df: DataFrame) -> DataFrame:
    return df


def kept(few, df: DataFrame, name: str) -> DataFrame:
    """A table of the rounds, written in few partitions."""
    return written(few(df), name)


def among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is among `ids` (one row each), with the ids' other columns. Up to `BROADCAST` ids,
    counted first, go to the texts; beyond that the join deals both by doc_id."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST else ids, "doc_id")


def words_of(docs: DataFrame, wanted: DataFrame, few=as_is) -> DataFrame:
    """(doc_id, words) of the wanted documents: hashes of 32 bits; of several texts of one doc_id the largest counts."""

    def shrink(batches):
        tables = byte_tables()
        for batch in slices(batches):
            out = []
            for _, _, data, starts in text_chunks(batch.column("text")):
                words, bounds = word_hashes(data, starts, tables)
                words = (words >> np.uint64(32)).astype(np.uint32)
                out.extend(words[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rank"), pa.array(out, pa.binary())], names=["doc_id", "rank", "words"])

    texts = among(docs, wanted).select("doc_id", text_rank("text").alias("rank"), "text")
    words = few(texts).mapInArrow(giving_back(shrink), "doc_id long, rank struct<size: int, hash: bigint>, words binary")
    return kept(few, words.groupBy("doc_id").agg(F.max_by("words", "rank").alias("words")), "words")


def verified(pairs: DataFrame, docs: DataFrame, similarity: float, few=as_is) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough."""
    wanted = kept(few, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "wanted")
    words = words_of(docs, wanted, few)
    both = pairs.join(words.select(F.col("doc_id").alias("b"), F.col("words").alias("words_b")), "b")
    both = both.join(words.select(F.col("doc_id").alias("a"), F.col("words").alias("words_a")), "a")

    def align(batches):
        for batch in batches:
            kept = []
            for k, (x, y) in enumerate(zip(views(batch.column("words_a")), views(batch.column("words_b")), strict=True)):
                if alike(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), similarity):
                    kept.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(kept, pa.int64())) for c in ("a", "b")], names=["a", "b"])

    return few(both.select("a", "b", "words_a", "words_b")).mapInArrow(giving_back(align), "a long, b long")


def lower_labels(labels: DataFrame, links: DataFrame, few=as_is) -> DataFrame:
    """(doc_id, label) after new links (a, b): the least label of a document and its neighbours, and that one's label.
    Documents without a label are their own class. Labels may still differ within a class, which costs comparisons
    that could be spared, but none that is needed."""
    ends = links.select("a", "b").union(links.select("b", "a")).withColumnsRenamed({"a": "doc_id", "b": "other"})
    near = ends.join(labels.select(F.col("doc_id").alias("other"), "label"), "other", "left")
    near = near.groupBy("doc_id").agg(F.min(F.coalesce("label", "other")).alias("near"))
    now = near.join(labels, "doc_id", "full").select("doc_id", F.least(F.coalesce("label", "doc_id"), "near").alias("label"))
    now = kept(few, now, "labels")
    jump = now.select(F.col("doc_id").alias("label"), F.col("label").alias("next"))
    return kept(few, now.join(jump, "label", "left").select("doc_id", F.coalesce("next", "label").alias("label")), "labels")


def with_labels(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.drop("label").join(labels, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))


def of_two_classes(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are not of one class yet."""
    for end in "ba":
        pairs = pairs.join(labels.select(F.col("doc_id").alias(end), F.col("label").alias(f"label_{end}")), end, "left")
    return pairs.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b")


def several_classes(members: DataFrame, labels: DataFrame, bitmaps: DataFrame, part: str, few=as_is, left: F.Column | None = None) -> DataFrame:
    """Members, with their present labels and bitmaps, of the parts that hold several classes, and of each part its
    `size`, `blocks`, and whether it is `large` (more than `PAIRWISE` members) and worth a `split` (more than `SPLIT` for
    each of the rows that a member would make in the next round, `left`)."""
    now = with_labels(members.drop("size", "blocks", "large", "split", "bits"), labels)
    size = F.count(F.lit(1))
    split = F.lit(True) if left is None else size > SPLIT * F.avg(left)
    about = size.alias("size"), F.ceil(F.greatest(size / BLOCK, F.sum("n_words") / BLOCK_WORDS)).alias("blocks"), (size > PAIRWISE).alias("large"), ((size > PAIRWISE) & split).alias("split")
    mixed = now.groupBy(part).agg(F.min("label").alias("low"), F.max("label").alias("high"), *about).where("low < high")
    return kept(few, now.join(mixed.drop("low", "high"), part).join(bitmaps, "doc_id"), "open")


def fit(one: str, other: str, similarity: float) -> F.Column:
    return F.least(one, other) >= similarity * F.greatest(one, other) - 1e-9


def pairs_to_try(members: DataFrame, part: str, similarity: float) -> DataFrame:
    """(a, b) of different classes that share a part: any two where it has few members, else each with two of them."""
    sides = "doc_id", "n_words", "label", "bits"
    small, large = members.where(~F.col("large")), members.where("large")
    within = small.join(small.select(part, *(F.col(c).alias(f"{c}_1") for c in sides)), part).where("doc_id_1 < doc_id")
    by, one = F.xxhash64("doc_id", F.lit(part)), F.struct(*sides)
    leaders = large.groupBy(part).agg(F.min_by(one, by).alias("x"), F.max_by(one, by).alias("y"))
    leaders = leaders.select(part, F.explode(F.array("x", "y")).alias("one")).select(part, *(F.col(f"one.{c}").alias(f"{c}_1") for c in sides))
    may = fit("n_words", "n_words_1", similarity) & few_bits_differ("bits", "bits_1", "n_words", "n_words_1", similarity)
    pairs = [p.where((F.col("label") != F.col("label_1")) & may) for p in (within, large.join(leaders, part))]
    pairs = [p.select(F.least("doc_id", "doc_id_1").alias("a"), F.greatest("doc_id", "doc_id_1").alias("b")) for p in pairs]
    return pairs[0].union(pairs[1]).distinct()


def first_parts(members: DataFrame, part: str) -> DataFrame:
    """(doc_id, firsts): the first `FIRST` parts of each text, the largest first. Two texts with a common part among
    these before a given one, in this order of all parts, meet there and need not meet in the given one."""
    parts = F.sort_array(F.collect_list(F.struct(-F.col("size"), part)))
    return members.groupBy("doc_id").agg(F.slice(parts, 1, FIRST).getField(part).alias("firsts"))


def meet_before(firsts: list[list[int]], part: int) -> np.ndarray:
    """Of each two texts, whether they meet in a part before this one."""
    before = [x[: x.index(part)] if part in x else x for x in firsts]
    at = {p: k for k, p in enumerate({p for x in before for p in x})}
    has = np.zeros((len(before), max(1, len(at))), np.float32)
    for k, x in enumerate(before):
        has[k, [at[p] for p in x]] = 1
    return has @ has.T > 0


def folded(bins: np.ndarray, to: int) -> np.ndarray:
    while bins.shape[1] > to:
        half = bins.shape[1] // 2
        bins = bins[:, :half] + bins[:, half:]
    return bins


def pairs_of_block(ids: np.ndarray, labels: np.ndarray, n: np.ndarray, bags: list, apart: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The places of each two texts of different classes that are not `apart` and may be similar, by `common_at_most`."""
    names, which = np.unique(labels, return_inverse=True)
    others = np.flatnonzero(which != np.bincount(which).argmax())  # any such pair has one end outside the largest class
    least, most = np.minimum.outer(n, n), np.maximum.outer(n, n)
    try_ = ~apart & (labels[:, None] != labels[None, :]) & (least >= similarity * most - 1e-9)
    other = np.zeros(len(ids), bool)
    other[others] = True
    try_ &= ~(other[:, None] & other[None, :]) | (ids[:, None] < ids[None, :])
    needed = most - ((1 - similarity) * most + 1e-9).astype(np.int64)
    rest = np.array([int(np.frombuffer(b, np.uint32, 1)[0]) for b in bags])
    width = np.array([2 * (len(b) - 4) for b in bags])
    place, counts = np.empty(len(ids), np.int64), {}
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        half = np.stack([np.frombuffer(bags[k], np.uint8, offset=4) for k in rows])
        place[rows], counts[w] = np.arange(len(rows)), np.concatenate([half & 15, half >> 4], axis=1).astype(np.uint16)
    found = [np.empty((2, 0), np.int64)]
    for k in others.tolist():
        own = counts[int(width[k])][place[k]][None, :]
        for w, bins in counts.items():
            rows = np.flatnonzero(try_[k] & (width == w))
            if len(rows):
                to = min(w, int(width[k]))
                common = np.minimum(folded(bins[place[rows]], to), folded(own, to)).sum(axis=1, dtype=np.int64)
                common += np.minimum(rest[rows], rest[k]) if w == width[k] else rest[rows] + rest[k]
                rows = rows[common >= needed[k, rows]]
                found.append(np.stack([np.full(len(rows), k), rows]))
    return tuple(np.concatenate(found, axis=1))


def pairs_of_small_parts(parts: np.ndarray, ids: np.ndarray, labels: np.ndarray, n: np.ndarray, bits: np.ndarray, bags: list, firsts: list, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The places of each two texts of different classes that share a part, not one before it, and may be similar, by
    their bitmaps and `common_at_most`."""
    by = np.lexsort((ids, parts))
    parts, ids, labels, n, bits = parts[by], ids[by], labels[by], n[by], bits[by]
    before = [frozenset(x[: x.index(p)] if p in x else x) for p, x in zip(parts.tolist(), (firsts[k] for k in by.tolist()), strict=True)]
    found, apart = [], 1
    while apart < len(ids) and (same := parts[apart:] == parts[:-apart]).any():
        x = np.flatnonzero(same & (labels[apart:] != labels[:-apart]))
        y = x + apart
        most = np.maximum(n[x], n[y])
        edits = ((1 - similarity) * most + 1e-9).astype(np.int64)
        may = (np.minimum(n[x], n[y]) >= similarity * most - 1e-9) & (np.bitwise_count((bits[x] ^ bits[y]).view(np.uint64)).sum(axis=1, dtype=np.int64) <= 2 * edits)
        for a, b, least in zip(x[may].tolist(), y[may].tolist(), (most - edits)[may].tolist(), strict=True):
            if before[a].isdisjoint(before[b]) and common_at_most(bags[by[a]], bags[by[b]]) >= least:
                found.append((by[a], by[b]))
        apart += 1
    return tuple(np.array(found, np.int64).reshape(-1, 2).T)


def links_within(x: np.ndarray, y: np.ndarray, ids: np.ndarray, labels: np.ndarray, words: list[bytes], similarity: float) -> list[tuple[int, int]]:
    """Links (a, b) among the pairs of places that join all classes which any similar pair joins: fewer than classes."""
    above: dict[int, int] = {}

    def top(c: int) -> int:
        while c in above:
            c = above[c]
        return c

    found = []
    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        p, q = top(int(labels[i])), top(int(labels[j]))
        if p != q and alike(np.frombuffer(words[i], np.uint32), np.frombuffer(words[j], np.uint32), similarity):
            above[max(p, q)] = min(p, q)
            found.append(tuple(sorted((int(ids[i]), int(ids[j])))))
    return found


def links_in_parts(members: DataFrame, part: str, bags: DataFrame, docs: DataFrame, similarity: float, few=as_is) -> DataFrame:
    """(a, b): links that join the classes of all similar texts which share a part. Pairs are found and aligned inside
    tasks and are no rows: a first pass tells the members that have a pair to align, a second has only their words.

    Members of a large part are dealt into blocks, and any two blocks meet in a group of at most twice a block; small
    parts are dealt into groups of many. In both passes a pair meets in one part (see `first_parts`)."""
    size = members.agg(F.count(F.lit(1)).alias("rows"), F.sum("n_words").alias("words")).first()
    decks = max(8, (size["rows"] or 0) // DECK, (size["words"] or 0) // BLOCK_WORDS)
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks"))
    sides = members.select(F.col(part).alias("part"), "doc_id", "n_words", "label", "bits", "blocks", "large", block.alias("block"))
    sides = sides.join(first_parts(members, part), "doc_id").join(bags.select("doc_id", "bag"), "doc_id")
    large = sides.where("large").withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    large = large.withColumns({"deck": F.col("part"), "i": F.least("block", "with"), "j": F.greatest("block", "with")}).drop("with")
    none = F.lit(-1).cast("long")
    small = sides.where("not large").withColumns({"deck": F.pmod(F.xxhash64("part"), F.lit(decks)), "i": none, "j": none})
    columns = "deck", "i", "j", "part", "doc_id", "n_words", "label", "block", "bits", "firsts", "bag"
    dealt = large.select(*columns).unionByName(small.select(*columns))

    def pairs(key, rows):
        part, ids, labels, n, block = (rows.column(c).to_numpy() for c in ("part", "doc_id", "label", "n_words", "block"))
        bags, firsts = rows.column("bag").to_pylist(), rows.column("firsts").to_pylist()
        if key[1].as_py() < 0:
            bits = rows.column("bits").combine_chunks().flatten().to_numpy().reshape(-1, BITS // 64)
            return pairs_of_small_parts(part, ids, labels, n, bits, bags, firsts, similarity)
        apart = meet_before(firsts, key[0].as_py())
        if key[1] != key[2]:
            apart |= block[:, None] == block[None, :]
        return pairs_of_block(ids, labels, n, bags, apart, similarity)

    def hopeful(key, rows):
        at = np.unique(np.concatenate(pairs(key, rows)))
        return pa.table({**{c: pa.array(np.full(len(at), k.as_py(), np.int64)) for c, k in zip("deck i j".split(), key, strict=True)}, **{c: rows.column(c).take(pa.array(at)) for c in columns[3:]}})

    def align(key, rows):
        x, y = pairs(key, rows)
        links = links_within(x, y, *(rows.column(c).to_numpy() for c in ("doc_id", "label")), rows.column("words").to_pylist(), similarity)
        return pa.table({c: pa.array([link[k] for link in links], pa.int64()) for k, c in enumerate("ab")})

    keys = "deck", "i", "j"
    left = dealt.groupBy(*keys).applyInArrow(hopeful, "deck long, i long, j long, part long, doc_id long, n_words long, label long, block long, bits array<long>, firsts array<long>, bag binary")
    left = kept(few, left, "hopeful-members")
    words = words_of(docs, kept(few, left.select("doc_id").distinct(), "wanted"), few)
    return left.join(words, "doc_id").groupBy(*keys).applyInArrow(align, "a long, b long").distinct()


def rare_words(words: DataFrame, similarity: float, few=as_is) -> DataFrame:
    """(doc_id, n_words, place, word): of each text the rarest labelled words, rarest first; as many as the edits that
    it may have, and one for each round. Only the counts of `BINS` bins of words go through the driver."""

    def of(batch):
        return [labelled_words(np.frombuffer(w, np.uint32).astype(np.uint64)) for w in views(batch.column("words"))]

    def count(batches):
        n = np.zeros(BINS, np.int64)
        for batch in slices(batches):
            n += np.bincount((np.concatenate([np.empty(0, np.uint64), *of(batch)]) % np.uint64(BINS)).astype(np.int64), minlength=BINS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["bin", "n"])

    counts = np.zeros(BINS, np.int64)
    for row in few(words).mapInArrow(giving_back(count), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        counts[row["bin"]] = row["n"]

    def choose(batches):
        for batch in slices(batches):
            found, sizes, own = [np.empty(0, np.uint64)], [], of(batch)
            for w in own:
                by = np.lexsort((w, counts[(w % np.uint64(BINS)).astype(np.int64)]))
                found.append(w[by[: edit_limit(len(w), similarity) + ROUNDS]])
                sizes.append(len(found[-1]))
            rows = np.repeat(np.arange(len(own)), sizes)
            places = np.concatenate([np.empty(0, np.int64), *(np.arange(n) for n in sizes)])
            n_words = np.array([len(w) for w in own], np.int64)[rows]
            arrays = [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(n_words), pa.array(places), pa.array(np.concatenate(found).view(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "place", "word"])

    return kept(few, few(words).mapInArrow(giving_back(choose), "doc_id long, n_words long, place long, word long"), "rare-words")


def may_come(round_: int, similarity: float) -> F.Column:
    """Whether a listed word can be the text's `round_`-th one in common with a similar text."""
    return F.col("place") < F.floor((1 - similarity) * F.col("n_words") + 1e-9) + round_


def words_left(round_: int, similarity: float) -> F.Column:
    """The listed words that may be a text's next one in common after its `round_`-th."""
    return F.floor((1 - similarity) * F.col("n_words") + 1e-9) + round_ - F.col("place")


def next_words(members: DataFrame, listed: DataFrame, round_: int, similarity: float) -> DataFrame:
    """Members of large parts (doc_id, place, list{round - 1}), each with every later word that may be the next one."""
    later = listed.where(may_come(round_, similarity)).withColumnRenamed("place", "then")
    both = members.select("doc_id", "place", f"list{round_ - 1}").join(later, "doc_id").where("then > place")
    return both.select("doc_id", "n_words", F.col("then").alias("place"), F.xxhash64(f"list{round_ - 1}", "word").alias(f"list{round_}"))


def split_deeper(members: DataFrame, docs: DataFrame, few=as_is) -> DataFrame:
    """Members of large buckets with the names of their parts at each depth; subsequences have no parts of their own."""
    buckets = kept(few, members.groupBy("doc_id").agg(F.collect_list("bucket").alias("buckets"), F.first("n_words").alias("n_words")), "buckets-of")
    texts = among(docs, buckets).select("doc_id", "text", "n_words", "buckets", text_rank("text").alias("rank"))
    columns = [f"part{k}" for k in range(1, len(DEEPER) + 1)]

    def run(batches):
        tables, shuffles = byte_tables(), orders()
        for batch in batches:
            rows, keys, parts, wanted = [], [], [], batch.column("buckets").to_pylist()
            for a, _, data, starts in text_chunks(batch.column("text")):
                words, bounds = word_hashes(data, starts, tables)
                for k, (i, j) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    mine = np.array(wanted[a + k], np.int64)
                    own, deep = deeper_sketches(words[i:j], shuffles)
                    by = np.argsort(own)
                    at = by[np.minimum(np.searchsorted(own, mine, sorter=by), max(0, len(own) - 1))] if len(own) else np.zeros(len(mine), np.int64)
                    same = own[at] == mine if len(own) else np.zeros(len(mine), bool)
                    named = np.repeat(mine[:, None], len(DEEPER), axis=1)
                    named[same] = mix(named[same].view(np.uint64) + deep[at[same]].view(np.uint64)).view(np.int64)
                    rows.append(np.full(len(mine), a + k))
                    keys.append(mine)
                    parts.append(named)
            rows, keys = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (rows, keys))
            parts = np.concatenate(parts) if parts else np.empty((0, len(DEEPER)), np.int64)
            carried = [batch.column(c).take(pa.array(rows)) for c in ("doc_id", "n_words", "rank")]
            yield pa.RecordBatch.from_arrays([*carried, pa.array(keys), *(pa.array(np.ascontiguousarray(x)) for x in parts.T)], names=["doc_id", "n_words", "rank", "bucket", *columns])

    schema = "doc_id long, n_words long, rank struct<size: int, hash: bigint>, bucket long, " + ", ".join(f"{c} long" for c in columns)
    found = few(texts).mapInArrow(giving_back(run), schema).groupBy("doc_id", "bucket").agg(F.first("n_words").alias("n_words"), *(F.max_by(c, "rank").alias(c) for c in columns))
    return kept(few, found, "parts")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its class), class_size, kept (is the one that stands for its class)."""
    with small_batches(docs.sparkSession):  # all Arrow steps are written before it ends
        return classes_of(docs, similarity)


def classes_of(docs: DataFrame, similarity: float) -> DataFrame:
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    profile = written(profiles(docs, similarity), "profiles")
    texts = profile.groupBy("doc_id").agg(F.max("rank").alias("rank"), F.max_by(F.struct("n_words", "h1", "h2"), "rank").alias("text")).select("doc_id", "rank", "text.*")
    copies = texts.where("n_words > 0").groupBy("h1", "h2").agg(F.min_by(F.struct("doc_id", "rank"), "doc_id").alias("one"))
    single = profile.join(copies.select("one.doc_id", F.col("one.rank").alias("its")), "doc_id").where(F.col("rank") == F.col("its"))
    single = written(single.dropDuplicates(["doc_id"]).select("doc_id", "h1", "h2", "n_words", "bag", "bits", "sketches"), "distinct-texts")
    n_parts = max(8, single.count() // ROWS)

    def few(df: DataFrame) -> DataFrame:
        return df.coalesce(n_parts)

    bags, marks = single.select("doc_id", "n_words", "bag"), single.select("doc_id", F.explode("sketches").alias("bucket"))
    first = marks.groupBy("bucket").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    buckets = kept(few, marks.join(first.select("bucket", "first"), "bucket").join(bags.select("doc_id", "n_words"), "doc_id"), "buckets")

    lengths = bags.select(F.col("doc_id").alias("first"), F.col("n_words").alias("n_first"))
    pairs = buckets.where("doc_id <> first").join(lengths, "first").where(fit("n_words", "n_first", similarity))
    firsts = kept(few, pairs.groupBy(F.col("first").alias("a"), F.col("doc_id").alias("b")).agg(F.count(F.lit(1)).alias("shared")), "firsts")
    nearest = F.max_by("a", F.struct("shared", -F.col("a"))).alias("a")
    none = docs.sparkSession.range(0)  # not createDataFrame: that is an RDD of Python, with workers of its own in each step
    tried = found = none.select(F.col("id").alias("a"), F.col("id").alias("b"))
    labels = none.select(F.col("id").alias("doc_id"), F.col("id").alias("label"))

    def compare(pairs: DataFrame) -> None:
        """Adds the links among the pairs that were not compared before."""
        nonlocal tried
        pairs = kept(few, pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        if not pairs.isEmpty():
            hopeful = kept(few, promising(pairs, bags, similarity, few), "hopeful")
            tried = tried.union(pairs)
            add(verified(hopeful, docs, similarity, few))

    def add(links: DataFrame) -> None:
        nonlocal found, labels
        new = kept(few, links, "links")
        found, labels = found.union(new), lower_labels(labels, new, few)

    compare(firsts.groupBy("b").agg(nearest).select("a", "b"))
    compare(of_two_classes(firsts.select("a", "b"), labels))

    bitmaps = single.select("doc_id", "bits")

    def meet_leaders(members: DataFrame) -> None:
        """Compares members of large buckets with the leaders of their deeper parts; all go on."""
        members = split_deeper(members, docs, few)
        for k in range(1, len(DEEPER) + 1):
            compare(pairs_to_try(several_classes(members, labels, bitmaps, f"part{k}", few), f"part{k}", similarity))

    def compare_listed(hot: DataFrame) -> None:
        """Compares members of large buckets by their rare words."""
        listed = rare_words(words_of(docs, kept(few, hot.select("doc_id").distinct(), "listed-ids"), few), similarity, few)
        members = listed.where(may_come(1, similarity)).withColumnRenamed("word", "list1")
        for k in range(1, ROUNDS + 1):
            members = several_classes(members, labels, bitmaps, f"list{k}", few, words_left(k, similarity))
            large = members.where("large")
            compare(pairs_to_try(large, f"list{k}", similarity))
            if k == ROUNDS and not large.isEmpty():
                meet_leaders(hot.join(large.select("doc_id").distinct(), "doc_id", "left_semi"))
            members = several_classes(members, labels, bitmaps, f"list{k}", few, words_left(k, similarity))
            here = members if k == ROUNDS else members.where(~F.col("split"))
            if not here.isEmpty():
                add(links_in_parts(here, f"list{k}", bags, docs, similarity, few))
            members = members.where("split")
            if k == ROUNDS or members.isEmpty():
                break
            members = next_words(members, listed, k + 1, similarity)

    members = several_classes(buckets.select("bucket", "doc_id", "n_words"), labels, bitmaps, "bucket", few)
    compare(pairs_to_try(members, "bucket", similarity))
    members = members.where("large")
    if not members.isEmpty():
        compare_listed(members)

    labels = components(found, most=n_parts).withColumnRenamed("id", "doc_id")
    classes = texts.join(single.select("h1", "h2", F.col("doc_id").alias("one")), ["h1", "h2"], "left")
    classes = classes.withColumn("one", F.when(F.col("n_words") > 0, F.col("one")).otherwise(F.col("doc_id")))
    classes = classes.join(labels.select(F.col("doc_id").alias("one"), "label"), "one", "left")
    classes = classes.select("doc_id", F.coalesce("label", "one").alias("class_id"))
    sizes = classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size"))
    return classes.join(sizes, "class_id").select("doc_id", "class_id", "class_size", (F.col("doc_id") == F.col("class_id")).alias("kept"))
