"""Personal data by fixed expressions, and by contexts that are learned from what those find.

Seeds are all matches of the four kinds (email, ip, card, phone). Candidates are other tokens that look like
identifiers: runs without white space that hold a digit or `@`, six characters at least without punctuation at their
ends. The two words before, the two after, and one on each side of a seed or candidate are its patterns. All
documents are then searched for each seed pattern, so that one that mostly stands around ordinary words is known.

Spark scores the graph of patterns and instances in rounds: a pattern's confidence for a kind is the share of its
occurrences, smoothed, that hold instances of the kind, each weighed by its score; an instance's score is the chance
that not all of its patterns err (seeds: 1). Patterns need `MIN_SEEDS` different instances and confidence
`MIN_CONFIDENCE` to speak; those around no candidate can add nothing and are not counted. Candidates that score as
much make patterns of their own known in the next round, like seeds; those that do so in the last of `ROUNDS` are
added, with the kind of the highest score.

Matches are leftmost and do not overlap within a kind; those that fail a kind's check are dropped without a retry.
Positions are code points, ends exclusive. A null or empty text has no spans. Rows are searched one by one, repeated
ids included. Other columns are not looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_tables, mix, text_chunks, word_hashes, written

# The kinds in their order, and their expressions.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

DIGIT = re.compile(r"[0-9]")
MARKED = re.compile(r"[0-9@]+")
BLANK = " \t\n\v\f\r"
EDGES = ".,;:!?()[]{}<>\"'#$%&*=+-/\\|~`^_"
LEAST = 6
MIN_SEEDS = 3
MIN_CONFIDENCE = 0.5
ROUNDS = 3
FILTER_BITS = 1 << 27  # at most; 16 for each pattern otherwise
HELD = 1 << 20  # patterns whose counts a task holds before it hands them on


def luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(doubled)) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """As the expression local-part@domain finds them, from each @ outward: no word without one is tried."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            last = match.end()
            found.append((start, last))
        at = text.find("@", max(at + 1, last))
    return found


def ips(text: str) -> list[tuple[int, int]]:
    """As the expression of four dotted numbers finds them: by fours along each longest chain of dotted numbers."""
    found = []
    for chain in NUMBERS.finditer(text):
        parts, at = chain[0].split("."), chain.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                found.append((at, end))
            at = end + 1
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind and start."""
    out = [(0, a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        out += [(1, a, b) for a, b in ips(text)]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        for m in PHONE.finditer(text) if "+" in text else ():
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Tokens that look like identifiers and touch no span."""
    taken = sorted((a, b) for _, a, b in taken)
    begins, ends = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    out, last = [], 0
    for m in MARKED.finditer(text):
        if m.start() < last:
            continue
        start, end = m.span()
        while start > last and text[start - 1] not in BLANK:
            start -= 1
        while end < len(text) and text[end] not in BLANK:
            end += 1
        last = end
        while start < end and text[start] in EDGES:
            start += 1
        while end > start and text[end - 1] in EDGES:
            end -= 1
        before = bisect_left(begins, end)
        if end - start >= LEAST and not (before and ends[before - 1] > start):
            out.append((start, end))
    return out


def context_hashes(before2, before1, after1, after2) -> np.ndarray:
    """The three patterns of a place from the words around it."""
    pairs = ((before2, before1, 1), (before1, after1, 2), (after1, after2, 3))
    return np.stack([mix(x * np.uint64(0x9FB21C651E98DF25) + y + np.uint64(k)) for x, y, k in pairs])


def search_texts(docs: DataFrame) -> DataFrame:
    """row, doc_id, spans (kind, start, end) and mentions (kind or -1, start, end, instance, patterns) of each row."""
    mention = "struct<kind: int, start: int, end: int, instance: bigint, patterns: array<bigint>>"
    schema = f"row long, doc_id long, spans array<struct<kind: int, start: int, end: int>>, mentions array<{mention}>"

    def run(batches):
        tables, row = byte_tables(), TaskContext.get().partitionId() << 33
        for batch in batches:
            spans, mentions = [], []
            for text in batch.column("text").to_pylist():
                found = base_spans(text) if text else []
                more = candidates(text, found) if text else []
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
                places = [*found, *((-1, a, b) for a, b in more)]
                mentions.append(described(text, places, tables) if places else [])
            rows = np.arange(row, row + len(spans))
            row += len(spans)
            kinds = [pa.field(c, pa.int32()) for c in ("kind", "start", "end")]
            mention_type = pa.struct([*kinds, pa.field("instance", pa.int64()), pa.field("patterns", pa.list_(pa.int64()))])
            arrays = [pa.array(rows), batch.column("doc_id"), pa.array(spans, pa.list_(pa.struct(kinds))), pa.array(mentions, pa.list_(mention_type))]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "doc_id", "spans", "mentions"])

    return docs.mapInArrow(run, schema)


def described(text: str, places: list[tuple[int, int, int]], tables: tuple) -> list[dict]:
    data = np.frombuffer(text.encode(), np.uint8)
    words, _ = word_hashes(data, np.array([0, len(data)]), tables)
    begins = np.flatnonzero(~tables[1][data] & np.append(True, tables[1][data[:-1]]))
    words = np.concatenate([np.zeros(2, np.uint64), words, np.zeros(3, np.uint64)])
    chars = np.flatnonzero((data & 0xC0) != 0x80)
    chars = np.append(chars, len(data))
    out = []
    for kind, a, b in places:
        first = int(np.searchsorted(begins, chars[a], "right")) + 1
        last = int(np.searchsorted(begins, chars[b - 1], "right")) + 1
        near = [words[i : i + 1] for i in (first - 2, first - 1, last + 1, last + 2)]
        raw = np.frombuffer(text[a:b].lower().encode(), np.uint8)
        instance = mix(np.uint64([np.bitwise_xor.reduce(mix(raw.astype(np.uint64) + (np.arange(len(raw), dtype=np.uint64) << np.uint64(8))))]))
        patterns = context_hashes(*near)[:, 0].view(np.int64).tolist()
        out.append({"kind": kind, "start": a, "end": b, "instance": int(instance.view(np.int64)[0]), "patterns": patterns})
    return out


def pattern_totals(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, total): how often each seed pattern occurs in all documents, around one word of any kind.

    A bitmap of fixed size, broadcast, lets occurrences of seed patterns through and few others; the join is exact.
    A task adds up what it lets through, so it hands a pattern on once for each `HELD` different ones.
    """
    size = min(FILTER_BITS, 1 << max(16, int(16 * patterns.count()).bit_length()))
    places = patterns.select(F.pmod("pattern", F.lit(size)).alias("at"))
    bits = F.bit_or(F.expr("shiftleft(1, cast(at % 8 AS int))"))
    found = places.groupBy(F.shiftright("at", 3).cast("int").alias("byte")).agg(bits.alias("bits")).toArrow()
    bitmap = np.zeros(size // 8, np.uint8)
    bitmap[found.column("byte").to_numpy()] = found.column("bits").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        tables, bitmap = byte_tables(), shared.value
        keys, counts, loose, n_loose = np.empty(0, np.uint64), np.empty(0, np.int64), [], 0

        def table():
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["pattern", "n"])

        def summed():
            every, at = np.unique(np.concatenate([keys, *loose]), return_inverse=True)
            return every, np.bincount(at, np.append(counts, np.ones(n_loose))).astype(np.int64)

        for batch in batches:
            for _, _, data, starts in text_chunks(batch.column("text")):
                words, bounds = word_hashes(data, starts, tables)
                n = len(bounds) - 1
                framed = np.zeros(len(words) + 4 * n, np.uint64)  # two empty words before and after each text
                own = np.arange(len(words)) + np.repeat(4 * np.arange(n) + 2, np.diff(bounds))
                framed[own] = words
                hashes = context_hashes(framed[own - 2], framed[own - 1], framed[own + 1], framed[own + 2]).ravel()
                at = hashes & np.uint64(8 * len(bitmap) - 1)
                hit = (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
                loose.append(hashes[hit.astype(bool)])
                n_loose += len(loose[-1])
                if n_loose >= HELD:
                    keys, counts = summed()
                    loose, n_loose = [], 0
                if len(keys) >= HELD:
                    yield table()
                    keys, counts = keys[:0], counts[:0]
        keys, counts = summed()
        yield table()

    counted = docs.select("text").mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("total"))
    return patterns.join(counted, "pattern", "left").select("pattern", F.coalesce("total", F.lit(0)).alias("total"))


def discover(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(instance, kind) of the candidates that confident patterns vouch for.

    In each round the patterns of seeds and of candidates believed so far are weighed; those that weren't yet are
    counted in all documents by one more pass over them.
    """
    mentions = found.select(F.explode("mentions").alias("m")).select("m.kind", "m.instance", F.explode("m.patterns").alias("pattern"))
    edges = written(mentions.groupBy("pattern", "instance", "kind").agg(F.count(F.lit(1)).alias("n")), "edges")
    open_patterns = edges.where("kind < 0").select("pattern").distinct()
    seeds = edges.where("kind >= 0").select("instance", "kind", F.lit(1.0).alias("score")).distinct()
    scores, counted, believed = seeds, None, None
    for k in range(ROUNDS):
        if believed is None:
            holders = edges.where("kind >= 0").select("pattern", "instance")
        else:
            holders = edges.select("pattern", "instance").join(believed.unionByName(seeds.select("instance")).distinct(), "instance", "left_semi")
        able = holders.groupBy("pattern").agg(F.count_distinct("instance").alias("held")).where(F.col("held") >= MIN_SEEDS).select("pattern")
        able = able.join(open_patterns, "pattern", "left_semi")
        fresh = written(able if counted is None else able.join(counted, "pattern", "left_anti"), "patterns")
        if not fresh.isEmpty():
            own = edges.join(fresh, "pattern", "left_semi").groupBy("pattern").agg(F.sum("n").alias("own"))
            more = pattern_totals(docs, fresh).join(own, "pattern").select("pattern", F.greatest("total", "own").alias("total"))
            counted = written(more if counted is None else counted.unionByName(more), "counted")
        if counted is None:
            break
        inside = edges.join(counted, "pattern")
        known = inside.drop("kind").join(scores, "instance")
        sure = known.groupBy("pattern", "kind").agg((F.sum(F.col("n") * F.col("score")) / (F.max("total") + 1)).alias("confidence"), F.count_distinct("instance").alias("instances"))
        sure = sure.where((F.col("instances") >= MIN_SEEDS) & (F.col("confidence") >= MIN_CONFIDENCE))
        reached = inside.where("kind < 0").select("pattern", "instance").join(sure, "pattern")
        doubt = F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.999)))))
        reached = written(reached.groupBy("instance", "kind").agg((1 - doubt).alias("score")), f"scores-{k}")
        scores = seeds.unionByName(reached)
        believed = reached.where(F.col("score") >= MIN_CONFIDENCE).select("instance")
        if reached.isEmpty():
            break
    best = scores.join(seeds, "instance", "left_anti").where(F.col("score") >= MIN_CONFIDENCE)
    return best.groupBy("instance").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, spans (base) and added of each row: arrays of (kind, start, end), by kind and start."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = written(search_texts(docs), "spans")
    new = discover(found, docs)
    loose = found.select("row", F.explode("mentions").alias("m")).where("m.kind < 0").select("row", "m.start", "m.end", "m.instance")
    added = loose.join(new, "instance").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("added"))
    none = F.array().cast("array<struct<kind: int, start: int, end: int>>")
    return found.join(added, "row", "left").select("doc_id", "spans", F.coalesce("added", none).alias("added"))


def written_out(spans) -> F.Column:
    """kind:start:end of spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
