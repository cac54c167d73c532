"""Benchmark decontamination by pigeonhole edit matching over words.

A test item of n words may differ from a passage by e = floor(max_error * n) word edits. Its words are split into
e + 1 pieces, so a passage within that budget holds at least one piece unchanged. Exact piece hits are found by
rolling hashes of the document's words; each place they point to is verified by Myers' bit-parallel edit distance.

Words are runs of characters other than white space and punctuation (ASCII, general, CJK and full-width), A-Z
lower-cased; in scripts that put no spaces between words each character is one. Items of fewer words than 1 / max_error
have no budget and match exact copies only, so an item of one word marks every text that has that word. Null and empty items, and those without a word, match
nothing; `min_words` can leave out items too short to tell. Null and empty texts match nothing. Rows are judged one by one, repeated ids included; other columns are not looked at.
Items are broadcast in slices of at most `slice_bytes` of text, each matched in a pass of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_tables, giving_back, schema_text, text_chunks, word_hashes

MAX_ERROR = 0.2
MIN_WORDS = 1
MULTIPLIER = np.uint64(0x2545F4914F6CDD1D)


def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    value, space, powers = byte_tables()
    for c in range(33, 128):
        space[c] |= not chr(c).isalnum()
    return value, space, powers


# Code points of punctuation and spaces beyond ASCII, and of scripts written without spaces between words.
SEPARATORS = ((0xA0, 0xA1), (0xAB, 0xAB), (0xB7, 0xB7), (0xBB, 0xBB), (0xBF, 0xBF), (0x2000, 0x206F), (0x3000, 0x303F), (0xFF00, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))
UNSPACED = ((0xE00, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x2FFF), (0x3040, 0xA4CF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


def split(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the bytes of UTF-8 text, which are of separators beyond ASCII, and where characters that stand alone, or what
    follows them, begin."""
    blank, begin = np.zeros(len(data), bool), np.zeros(len(data) + 1, bool)
    at = np.flatnonzero(data >= 0xC2)  # first bytes of longer characters
    size = 2 + (data[at] >= 0xE0).astype(np.int64) + (data[at] >= 0xF0)
    whole = at + size <= len(data)
    at, size = at[whole], size[whole]
    code = data[at] & (0xFF >> (size + 1))
    code = code.astype(np.int64)
    for k in range(1, 4):
        more = size > k
        code[more] = (code[more] << 6) | (data[at[more] + k] & 0x3F)
    within = lambda ranges: np.any([(code >= low) & (code <= high) for low, high in ranges], axis=0)
    gone, alone = within(SEPARATORS), within(UNSPACED)
    for k in range(4):
        blank[at[gone & (size > k)] + k] = True
    begin[at[alone]] = begin[at[alone] + size[alone]] = True
    return blank, begin[:-1]


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words."""
    h = words[: len(words) - size + 1].copy()
    for k in range(1, size):
        h = h * MULTIPLIER + words[k : len(words) - size + 1 + k]
    return h


def myers(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """The smallest edit distance of the pattern to any run of the text, and the first place where one ends."""
    n = len(pattern)
    full, top = (1 << n) - 1, 1 << (n - 1)
    equal: dict[int, int] = {}
    for k, w in enumerate(pattern):
        equal[w] = equal.get(w, 0) | 1 << k
    plus, minus, score = full, 0, n
    best, end = n, 0
    for j, w in enumerate(text, 1):
        eq = equal.get(w, 0)
        x = eq | minus
        d = ((((eq & plus) + plus) ^ plus) | eq) & full
        hp = minus | ~(d | plus) & full
        hm = plus & d
        score += bool(hp & top) - bool(hm & top)
        hp, hm = (hp << 1) & full, (hm << 1) & full
        plus, minus = hm | ~(x | hp) & full, hp & x
        if score < best:
            best, end = score, j
    return best, end


class Items:
    """Test items with their pieces, sorted by piece hash for each piece length."""

    def __init__(self, ids: list[int], texts: list[str], max_error: float, min_words: int):
        data = np.frombuffer("\n".join(texts).encode(), np.uint8)
        starts = np.append(0, np.cumsum([len(t.encode()) + 1 for t in texts]))
        starts[-1] = len(data)
        words, bounds = word_hashes(data, starts, tables(), split) if len(data) else (np.empty(0, np.uint64), np.zeros(len(texts) + 1, int))
        self.ids, self.words, self.budgets = ids, [words[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)], []
        found: dict[int, list[tuple[int, int, int]]] = {}
        for k, w in enumerate(self.words):
            e = int(max_error * len(w) + 1e-9)
            self.budgets.append(e)
            if len(w) < max(1, min_words):
                continue
            size = len(w) // (e + 1)
            hashes = windows(w, size)
            for p in range(e + 1):
                found.setdefault(size, []).append((int(hashes[p * size]), k, p * size))
        self.pieces = {}
        for size, rows in found.items():
            rows.sort()
            hashes = np.array([r[0] for r in rows], np.uint64)
            seen = np.zeros(1 << 20, bool)
            seen[(hashes >> np.uint64(44)).astype(np.int64)] = True
            self.pieces[size] = hashes, np.array([r[1:] for r in rows]), seen

    def matches(self, words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, word after the match's last, distance): the best match of each item in each text."""
        wanted: dict[tuple[int, int], set[int]] = {}
        for size, (hashes, where, seen) in self.pieces.items():
            if len(words) < size:
                continue
            h = windows(words, size)
            at = np.flatnonzero(seen[(h >> np.uint64(44)).astype(np.int64)])
            first, last = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
            doc = np.searchsorted(bounds, at, "right") - 1
            hit = (last > first) & (at + size <= bounds[doc + 1])
            for place, d, i, j in zip(at[hit].tolist(), doc[hit].tolist(), first[hit].tolist(), last[hit].tolist(), strict=True):
                for k, offset in where[i:j].tolist():
                    wanted.setdefault((d, k), set()).add(place - offset)
        out = []
        for (d, k), begins in wanted.items():
            item, e = self.words[k], self.budgets[k]
            low, high, best, done = int(bounds[d]), int(bounds[d + 1]), None, -1
            for begin in sorted(begins):
                if begin <= done:  # the last window covered every alignment of this hit
                    continue
                a, b = max(low, begin - e), min(high, begin + len(item) + 2 * e)
                done = begin + e if len(begins) > 1 else begin
                exact = begin >= low and np.array_equal(words[begin : begin + len(item)], item) and begin + len(item) <= high
                distance, end = (0, begin + len(item) - a) if exact else myers(item.tolist(), words[a:b].tolist())
                if distance <= e and (best is None or distance < best[1]):
                    best = a + end - low, distance
                if distance == 0:  # nothing later is better
                    break
            if best is not None:
                out.append((d, k, *best))
        return out


def find_leaks(docs: DataFrame, items: DataFrame, max_error: float = MAX_ERROR, min_words: int = MIN_WORDS, slice_bytes: int = 1 << 26, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, contaminated, n_items and the leaks found (item_id, end_word, distance; one for each item row, in the
    items' order) of each row of `docs`, with its text and the columns to carry along. An empty table of items leaves every document clean."""
    items = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where(F.length("text") > 0)
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_slices = max(1, -(-int(size) // slice_bytes))
    found = None
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *carry)
    leak = "array<struct<item_id: bigint, end_word: int, distance: int>>"
    for k in range(n_slices):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(n_slices)) == k).orderBy("item_id", "text").collect()
        given = rows.withColumn("leaks", F.array().cast(leak)) if found is None else found
        found = scan(given, [r["item_id"] for r in part], [r["text"] for r in part], max_error, min_words)
    return found.select("doc_id", "text", *carry, (F.size("leaks") > 0).alias("contaminated"), F.size("leaks").cast("long").alias("n_items"), "leaks")


def scan(rows: DataFrame, ids: list[int], texts: list[str], max_error: float, min_words: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((ids, texts))

    def run(batches):
        known, marks = Items(*shared.value, max_error, min_words), tables()
        for batch in batches:
            leaks = batch.column("leaks").to_pylist()
            for a, _, data, starts in text_chunks(batch.column("text")):
                words, bounds = word_hashes(data, starts, marks, split)
                for d, k, end, distance in sorted(known.matches(words, bounds)):
                    leaks[a + d] = [*leaks[a + d], {"item_id": known.ids[k], "end_word": end, "distance": distance}]
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("end_word", pa.int32()), ("distance", pa.int32())]))
            rest = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*map(batch.column, rest), pa.array(leaks, kind)], names=[*rest, "leaks"])

    return rows.mapInArrow(giving_back(run), schema_text(rows, rows.columns)[2:])
