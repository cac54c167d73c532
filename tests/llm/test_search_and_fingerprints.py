"""Hard negatives, fingerprints and lexical search against literal versions, and on odd tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import fingerprints as P
from fieldloom.llm import lexical, negatives

VECTORS = "vec_id long, label long, embedding array<double>, pivot int, search string"


def literal_mine(rows, anchors, positives=5, k=10, scale=256):
    def whole(v):
        return [math.floor(scale * x) for x in v]

    def usable(r):
        return None not in r[:3] and all(x is not None and math.isfinite(x) for x in r[2])

    def score(a, b):
        return min(max(sum(x * y for x, y in zip(a, b)), -(2**63)), 2**63 - 1)  # noqa: B905  shorter ones end in zeros

    rows, asked = [(i, n, whole(v)) for i, n, v in filter(usable, rows)], {}
    for i, n, v in filter(usable, anchors):
        asked[i] = max(asked.get(i, (n, v)), (n, v))
    out = []
    for i, (n, v) in asked.items():
        scored = sorted((-score(whole(v), x), j, m) for j, m, x in rows if j != i)
        for p, j, _ in [r for r in scored if r[2] == n][:positives]:
            found = [r for r in scored if r[2] != n and 30 * -p <= 100 * -r[0] <= 90 * -p][:k]
            out += [(i, j, rank, m, -p, -s) for rank, (s, m, _) in enumerate(found, 1)]
    return sorted(out)


def mined(spark, rows, anchors):
    frames = [spark.createDataFrame([(*r, 1, "x") for r in part], VECTORS) for part in (rows, anchors)]
    columns = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(map(tuple, negatives.mine(*frames).select(*columns).collect()))


def crowd(seed, n, wide=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, wide))
    return [(i, int(rng.integers(4)), (centres[rng.integers(5)] + rng.normal(size=wide) * 0.3).tolist()) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives_equal_a_literal_search(spark, seed):
    rows = crowd(seed, 400)
    rows += [(1000 + k, k % 2, rows[7][2]) for k in range(40)]  # ties
    assert mined(spark, rows, rows[:12]) == literal_mine(rows, rows[:12])


def test_hard_negatives_on_odd_rows(spark):
    rows = crowd(3, 60)
    rows += [(200, 1, None), (201, None, [1.0] * 6), (None, 1, [1.0] * 6), (202, 2, [1.0, None, 1.0]), (203, 2, [float("nan")] * 6), (204, 2, [float("inf")] * 6)]
    rows += [(205, 0, []), (206, 3, [0.5, 0.5]), (207, 1, [0.0] * 6), (208, 2, [0.25] * 9), (209, 1, [1e6] * 6), (210, 0, [-1e7, 1e6, 3e3, 1.0, 0.0, 2.0])]
    rows += [rows[5], rows[5], (11, 3, rows[4][2])]
    anchors = [*rows[:6], *rows[60:]]
    assert mined(spark, rows, anchors) == literal_mine(rows, anchors)


def test_hard_negatives_of_huge_values_are_held_within_64_bits(spark):
    rows = [(k, k % 2, [1e300 * (k + 1), -1e290]) for k in range(6)] + [(10 + k, k % 2, [float(k), 1.0]) for k in range(6)]
    assert mined(spark, rows, rows[:3]) == literal_mine(rows, rows[:3])


def test_hard_negatives_of_empty_tables(spark):
    rows = crowd(4, 20)
    assert mined(spark, [], []) == mined(spark, rows, []) == mined(spark, [], rows[:2]) == []
    assert mined(spark, [(1, 1, [1.0])], [(1, 1, [1.0])]) == []


def test_annuli_skip_rows_of_distant_clusters(spark):
    """Two far clusters: the keys of the other cluster are outside every interval."""
    rng = np.random.default_rng(5)
    points = np.vstack([rng.normal(size=(200, 3)) * 0.01 + 1, rng.normal(size=(200, 3)) * 0.01 - 1])
    space = negatives.Space(3, float((np.floor(256 * points) ** 2).sum(axis=1).max()))
    whole = np.floor(256 * points)
    space.place_pivots(whole)
    searches = negatives.Searches(space, whole[:1], np.array([0]), np.array([0]), np.array([0]), np.array([negatives.LEAST]), np.array([negatives.MOST]), True, 5)
    searches.start(np.arange(400), np.zeros(400, int), whole)
    keys = space.distances(space.lifted(whole))
    near, at = keys.argmin(axis=1), keys.min(axis=1)
    inside = np.zeros(400, bool)
    for p in range(len(space.pivots)):
        low, high = searches.intervals(p, searches.outer)
        inside |= (near == p) & (at >= low[0]) & (at <= high[0])
    assert inside[:200].any()
    assert not inside[200:].any()


# fingerprints


def literal_features(text: bytes, ranks):
    """The improbable features by the definition, with plain loops."""
    if len(text) < P.SHORT:
        n = P.SHORT_WINDOW
        return [text[k : k + n] for k in range(max(1, len(text) - n + 1))] if text else []

    def bin_of(run):
        total = sum(round(c * math.log2(c) * 2**20) if c > 1 else 0 for c in Counter(run).values())
        most = round(P.WINDOW * math.log2(P.WINDOW) * 2**20)
        return P.BINS + (-P.BINS * total) // most

    bins = [bin_of(text[k : k + P.WINDOW]) for k in range(len(text) - P.WINDOW + 1)]
    points = Counter()
    spans = len(bins) - P.SPAN + 1
    for s in range(spans):
        allowed = [(ranks[b], s + k) for k, b in enumerate(bins[s : s + P.SPAN]) if b >= P.LEAST_BIN]
        if allowed:
            points[min(allowed)[1]] += 1
    return [text[k : k + P.WINDOW] for k in sorted(points) if points[k] >= min(P.POINTS, spans)]


def texts_of(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(300)] + ["été", "漢字", "----", "aaaa"]
    return [" ".join(rng.choices(words, k=rng.choice([1, 5, 20, 60, 400]))) for _ in range(n)] + ["", "a", "a" * 500, "\x00" * 90, "x" * 127, "xy" * 64]


def test_features_equal_the_definition():
    texts, ranks = [t.encode() for t in texts_of(1, 25)], list(range(P.BINS, -1, -1))
    digests = P.Digester(ranks).of_texts(texts)
    for text, (counts, _) in zip(texts, digests, strict=True):
        assert counts.sum() == len(set(literal_features(text, ranks))), text[:80]
    for text, digest in zip(texts, digests, strict=True):  # the same alone as among others
        assert P.as_text(P.Digester(ranks).of_texts([text])[0]) == P.as_text(digest)
        back = P.from_text(P.as_text(digest))
        assert np.array_equal(back[0], digest[0]) and np.array_equal(back[1], digest[1])


def test_ranks_count_every_window(spark):
    texts = texts_of(2, 12)
    counts = Counter()
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        counts.update(P.entropy_bins(data).tolist())
    got = P.learn_ranks(spark.createDataFrame([(t,) for t in [*texts, None]], "text string").repartition(3))
    order = sorted(range(P.BINS + 1), key=lambda b: (counts[b], b))
    assert [order.index(b) for b in (0, 500, 700, 800, 900)] == [got[b] for b in (0, 500, 700, 800, 900)]


def test_edit_trial_equals_a_literal_walk(spark):
    rows = [(k * 3, t) for k, t in enumerate(texts_of(3, 60))] + [(None, "no id"), (9, None), (9, "twice"), (9, "twice")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, range string, h int").repartition(5)
    got = P.edit_trial(docs).collect()
    assert len(got) == len(rows)
    by_hash = {t: h for t, h in spark.createDataFrame([(r[1] or "",) for r in rows], "t string").select("t", F.xxhash64("t")).collect()}
    ordered = sorted(((-1 if i is None else i, by_hash[t or ""], t or "") for i, t in rows))
    want = []
    for (i, _, text), (_, _, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        n = len(text) // 4
        want.append((i, len(text), hashlib.sha256((text[: len(text) - n] + after[:n]).encode()).hexdigest()))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
    for r in got:
        a, b = P.from_text(r["fingerprint"]), P.from_text(r["edited_fingerprint"])
        assert r["near_edited"] == pytest.approx(P.likeness(a, b)) and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    long = [r for r in got if r["n_chars"] >= 400 and r["doc_id"] not in (None, 9)]
    assert np.median([r["near_edited"] for r in long]) > 0.55
    assert np.median([r["near_next"] for r in long]) < 0.05


def test_fingerprints_of_empty_and_equal_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "the same words here"), (4, "the same words here")], "doc_id long, text string")
    found = {r["doc_id"]: r["fingerprint"] for r in P.fingerprints(docs).collect()}
    assert found[1] == found[2] == "" and found[3] == found[4] != ""
    assert P.edit_trial(docs.limit(0)).count() == 0
    assert P.edit_trial(docs.where("doc_id = 3")).first()["near_next"] == 1.0
    pairs = spark.createDataFrame([(found[3], found[4], 1), (found[3], "", 2), (found[3], None, 3)], "x string, y string, likeness int")
    assert [r[0] for r in P.compared(pairs, "x", "y", "like").orderBy("likeness").select("like").collect()] == [1.0, 0.0, None]


# lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def literal_search(docs, items, k=10):
    known = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in known), sum(c.total() for _, c in known)
    df, asked, out = Counter(w for _, c in known for w in c), {}, []
    for i, t in items:
        if i is not None and t:
            asked[i] = max(asked.get(i, ""), t)
    for i, t in asked.items():
        scored = []
        for d, c in known:
            if d is not None and c:
                m = 25 + (75 * c.total() * n_docs) // n_terms
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in terms(t) if c[w])
                scored += [(-score, d)] if score > 0 else []
        out += [(i, rank, d, -s) for rank, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("shard_postings", [50, 1 << 20])
def test_lexical_search_equals_a_literal_one(spark, shard_postings):
    rng = random.Random(6)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)] + ["Été", "ÉTÉ", "漢字", "STRASSE", "straße", "x1y2", "İ", "a" * 400, "A" * 400]
    docs = [(k, rng.choice([" ", "-", "\n", "，"]).join(rng.choices(words, k=rng.choice([1, 5, 40, 300])))) for k in range(150)]
    docs += [(500, None), (501, ""), (502, "--- !"), (None, "w1 w2 w3"), (503, docs[3][1]), (504, docs[3][1]), (3, docs[3][1])]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([1, 4, 30])))) for k in range(25)]
    items += [(100, None), (101, ""), (102, "nowhere"), (None, "w1"), (3, "zz w1 w1 w1"), (103, docs[3][1])]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, shard int, term string").repartition(3)
    asked = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, score int")
    got = lexical.search(frame, asked, shard_postings=shard_postings).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, got)) == literal_search(docs, items)
    sliced = lexical.search(frame, asked, shard_postings=shard_postings, slice_bytes=1 << 12).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(sliced) == sorted(got)


def test_lexical_search_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "two three")], "item_id long, text string")
    assert lexical.search(docs.limit(0), items).count() == lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs, items.withColumn("text", F.lit("..."))).count() == 0
    assert lexical.search(docs, items).count() == 1


def test_blocks_are_the_cheapest_cuts():
    """The dynamic program against all ways to cut a short list."""
    rng = np.random.default_rng(7)
    for n in (1, 2, 7, 11):
        scores = rng.integers(1, 100, n)

        def cost(cuts, scores=scores, n=n):
            ends = [*cuts[1:], n]
            return sum((b - a) * scores[a:b].max() for a, b in zip(cuts, ends, strict=True)) + lexical.BLOCK_COST * scores.mean() * len(cuts)

        got = lexical.block_starts(scores, np.array([0, n])).tolist()
        ways = [[0, *(k for k in range(1, n) if mask >> (k - 1) & 1)] for mask in range(1 << (n - 1))]
        assert cost(got) == pytest.approx(min(map(cost, ways)))


def test_blocks_are_skipped_and_keep_their_lists():
    rng = np.random.default_rng(8)
    starts = np.array([0, 700, 701, 1500])
    begin = lexical.block_starts(rng.integers(1, 1000, 1500), starts)
    assert set(starts[:-1].tolist()) <= set(begin.tolist())
    assert np.diff(np.append(begin, 1500)).max() <= lexical.LONGEST_BLOCK
    # one rare term with high scores in few documents: when they are found, blocks of the common one alone are left unread
    common, rare = np.arange(0, 20000, 2), np.arange(0, 20000, 500)
    places = np.concatenate([common, rare])
    counts = np.ones(len(places), np.int64)
    shard = lexical.Shard(np.arange(20000), np.full(20000, 50), np.array([0, 1]), places, counts, np.array([0, len(common), len(places)]), np.array([700, 9000]), 20000, 1_000_000)
    ids, scores = shard.best(np.array([0, 1]), np.array([1, 1]), 5)
    assert ids.tolist() == [0, 500, 1000, 1500, 2000] and len(set(scores.tolist())) == 1
    assert shard.read < len(places) / 2
