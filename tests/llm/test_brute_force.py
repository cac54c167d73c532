"""Operators against plain models of the same method, on small tables; the registered queries' columns."""

from __future__ import annotations

import collections
import math
import random
import re
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import langid, near_dup, pii, quality, queries
from fieldloom.llm import lm_scoring as LM
from fieldloom.llm.common import byte_tables, mix, word_hashes

from .test_text_operators import classes, frame, words

SF = "/root/testdata/sf0.001"


def test_long_words_have_hashes_of_their_own():
    base = bytearray(b"abcdefghij" * 900)
    other, upper = bytearray(base), bytes(base).upper()
    other[5000], other[100] = base[100], base[5000]
    other[5001], other[101] = base[101], base[5001]
    other[7], other[4103] = ord("x"), ord("y")
    texts = [bytes(base), bytes(other), upper, b"short " + bytes(base) + b" end"]
    starts = np.append(0, np.cumsum([len(t) for t in texts]))
    h, bounds = word_hashes(np.frombuffer(b"".join(texts), np.uint8), starts, byte_tables())
    assert bounds.tolist() == [0, 1, 2, 3, 6]
    assert h[0] == h[2] == h[4] and h[0] != h[1] and len(set(h.tolist())) == 4


def test_base_spans_equal_their_expressions():
    expressions = (
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
    )

    def passes(kind, s):
        digits = [int(c) for c in s if c.isdigit()]
        if kind == 1:
            return all(int(p) <= 255 for p in s.split("."))
        if kind == 2:
            doubled = [d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))]
            return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
        return kind == 0 or 9 <= len(digits) <= 15

    r = random.Random(21)
    for _ in range(6000):
        letters = r.choice(["0123456789 -", "01.25", "+1 ().-9", "a1.@-+ 5"])
        t = "".join(r.choice(letters) for _ in range(r.randrange(45)))
        want = [(k, *m.span()) for k, e in enumerate(expressions) for m in re.finditer(e, t) if passes(k, m[0])]
        assert pii.base_spans(t) == want, t
    assert pii.base_spans("0" * 5000 + "1.2.3.4") == [(1, 0, 5007)]
    assert pii.base_spans("9" * 200_000) == [] and pii.base_spans("1." * 100_000)[-1][0] == 1
    assert pii.candidates("a1b2c3d4 " * 3, [(0, 0, 8), (1, 18, 20)]) == [(9, 17)]


def test_discovered_identifiers_teach_patterns(spark):
    """ids of another form stand where e-mails do, and alone in a second context, which only they can teach."""
    r = random.Random(22)
    near = lambda i: " ".join(words(r, 6)) + f" reach me at {i} now " + " ".join(words(r, 6))
    rows = [(i, near(f"user{i}@mail.example.com")) for i in range(40)]
    rows += [(100 + i, near(f"john{i}(at)mail{i}")) for i in range(12)]
    rows += [(200 + i, " ".join(words(r, 6)) + f" signed by handle john{i}(at)mail{i} of staff") for i in range(12)]
    rows += [(300, "lorem signed by handle mary77(at)desk of staff"), (301, "lorem the part number AB12345678 of ipsum")]
    added = {x["doc_id"]: [tuple(s) for s in x["added"]] for x in pii.find_personal_data(frame(spark, rows)).collect()}
    assert all(len(added[100 + i]) == 1 for i in range(12))
    assert added[300] == [(0, 23, 37)] and added[301] == []


def test_scores_equal_a_dictionary_model(spark, monkeypatch):
    r = random.Random(23)
    rows = [(i, " ".join(words(r, r.randrange(1, 60), 60))) for i in range(150)]
    docs = frame(spark, rows)
    learned = []
    learn = LM.learn_weights
    monkeypatch.setattr(LM, "learn_weights", lambda held: learned.append((held, learn(held))) or learned[-1][1])
    got = {x["doc_id"]: x["score"] for x in LM.score_texts(docs, F.col("doc_id") % 7 != 2, block_bytes=2500).collect()}
    size = sum(len(t) for _, t in rows)
    n_blocks = max(LM.HELD_OUT, -(-size // 2500))
    block = {x[0]: x[1] for x in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(n_blocks))).collect()}
    tokens = {i: [None, *t.lower().split(), None] for i, t in rows}  # None: the end, also before the first word

    def counts(ids):
        one = collections.Counter(w for i in ids for w in tokens[i][1:])
        return one, collections.Counter(p for i in ids for p in zip(tokens[i][:-1], tokens[i][1:], strict=True))

    train = [i for i, _ in rows if i % 7 != 2]
    one, two = counts(train)
    v = len(one)
    kept_one, kept_two = counts([i for i in train if block[i] % LM.HELD_OUT])
    octave = lambda c: min(math.ceil(math.log2(c + 1)), LM.BUCKETS - 1)
    step = lambda x: round(LM.STEPS * math.log2(x)) if x else -32768
    want = collections.Counter()
    for i in train:
        if block[i] % LM.HELD_OUT == 0:
            for h, w in zip(tokens[i][:-1], tokens[i][1:], strict=True):
                pair = kept_two[h, w] / max(kept_one[h], 1) * (v + 1)
                want[octave(kept_one[h]), step(pair), step(kept_one[w] / sum(kept_one.values()) * (v + 1))] += 1
    held, weights = learned[0]
    assert {tuple(x[:3]): x[3] for x in held[["octave", "pair", "word", "n"]].itertuples(index=False)} == want
    for i, _ in rows:
        score = 0.0
        for h, w in zip(tokens[i][:-1], tokens[i][1:], strict=True):
            x = weights[octave(one[h])]
            score += math.log10(x[0] * two[h, w] / max(one[h], 1) + x[1] * one[w] / sum(one.values()) + x[2] / (v + 1))
        assert got[i] == pytest.approx(score)


def test_perplexities_equal_a_literal_kneser_ney(spark):
    r = random.Random(24)
    rows = [(i, "".join(r.choice("abcab ") for _ in range(r.randrange(1, 40)))) for i in range(60)]
    docs = frame(spark, rows)
    trusted, n = [t for i, t in rows if i < 40], 4
    framed = lambda t: [""] * 3 + list(t) + ["</s>"]
    count = {4: collections.Counter(tuple(x[k : k + 4]) for x in map(framed, trusted) for k in range(len(x) - 3))}
    for k in (3, 2, 1):
        count[k] = collections.Counter(g[1:] for g in count[k + 1])
    off = {}
    for k in range(1, n + 1):
        c = collections.Counter(count[k].values())
        y = c[1] / (c[1] + 2 * c[2]) if c[1] and c[2] else 0.5
        raw = [j - (j + 1) * y * c[j + 1] / c[j] if c[j] else 0.5 for j in (1, 2, 3)]
        off[k] = [min(max(d, 0.1), j - 0.05) for j, d in enumerate(raw, 1)]
    contexts = {k: collections.defaultdict(list) for k in count}
    for k, grams in count.items():
        for g, c in grams.items():
            contexts[k][g[:-1]].append(c)

    def p(g):
        if not g:
            return 1 / (len(count[1]) + 1)
        seen = contexts[len(g)].get(g[:-1])
        if not seen:
            return p(g[1:])
        d = off[len(g)]
        c = count[len(g)][g]
        left = sum(d[min(x, 3) - 1] for x in seen) / sum(seen)
        return (c - d[min(c, 3) - 1] if c else 0) / sum(seen) + left * p(g[1:])

    model = quality.fit(docs.where("doc_id < 40"))
    for most in (quality.BROADCAST, 0):
        got = {x["doc_id"]: x["perplexity"] for x in quality.perplexities(docs, model, most).collect()}
        for i, t in rows:
            x = framed(t)
            logs = [math.log10(p(tuple(x[k : k + 4]))) for k in range(len(x) - 3)]
            assert got[i] == pytest.approx(10 ** (-sum(logs) / len(logs)))


def test_languages_equal_sets_of_trigrams(spark):
    r = random.Random(25)
    sounds = {"aa": "kat mo su", "bb": "katü sche ng", "cc": "ñe cio mo"}
    rows = [(i, " ".join(r.choice(sounds[g].split()) + r.choice("aeiou") for _ in range(r.randrange(3, 60))), g) for i, g in enumerate(list(sounds) * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    grams = lambda t: [x[k : k + 3] for x in [" " + re.sub(r"\W+", " ", t.lower()).strip() + " "] for k in range(len(x) - 2) if x[k + 1] != " "]
    count = {g: collections.Counter(x for i, t, h in rows if h == g and i < 60 for x in grams(t)) for g in sounds}
    rate = {g: {x: n / sum(c.values()) for x, n in c.items()} for g, c in count.items()}
    best = collections.Counter()
    for c in rate.values():
        for x, n in c.items():
            best[x] = max(best[x], n)
    known = {g: {x for x, n in c.items() if n >= langid.MIN_RATE and n >= langid.SHARE * best[x]} for g, c in rate.items()}
    got = {x["doc_id"]: x for x in langid.identify(docs, langid.learn(docs.where("doc_id < 60"))).collect()}
    close = 0
    for i, t, _ in rows:
        share = {g: sum(x in known[g] for x in grams(t)) / len(grams(t)) for g in sounds}
        top = max(share.values())
        if sorted(share.values())[-2] < top - 0.05:  # else false positives of the filters may tip the scales
            assert got[i]["lang_pred"] == max(share, key=share.get)
        close += abs(got[i]["score"] - top / sum(share.values())) < 0.02
    assert close >= 0.95 * len(rows)


def test_texts_with_a_fifth_of_their_words_changed_are_candidates():
    orders, r = near_dup.orders(), np.random.default_rng(26)
    lengths = near_dup.short_lengths(near_dup.SIMILARITY)
    for n in (12, 40, 100, 300, 1000):
        hits = 0
        for _ in range(150):
            x = r.integers(1, 2**63, n, dtype=np.uint64)
            y, at = x.copy(), r.choice(n, n // 5, replace=False)
            y[at] = r.integers(1, 2**63, len(at), dtype=np.uint64)
            marks = [np.append(near_dup.sketches(w, orders), near_dup.subsequences(w, near_dup.SIMILARITY, lengths)) for w in (x, y)]
            hits += bool(np.isin(*marks).any())
        assert hits >= 0.85 * 150, n


def test_near_duplicates_equal_all_pairs(spark):
    r = random.Random(27)
    rows = []
    for g in range(50):
        base = [f"v{r.randrange(500)}" for _ in range(r.randrange(6, 90))]
        for _ in range(6):
            copy = list(base)
            for _ in range(r.randrange(1 + len(base) // 6)):
                at, kind = r.randrange(len(copy)), r.randrange(3)
                copy[at : at + (kind > 0)] = [f"v{r.randrange(500)}"] if kind < 2 else []
            rows.append((len(rows), " ".join(copy)))
    found = {x["doc_id"]: x["class_id"] for x in near_dup.near_duplicates(frame(spark, rows)).collect()}
    want = classes(rows)
    linked = [i for i in want if want[i] != i]
    assert all(found[i] >= want[i] for i in want)  # no false link: a class is never larger
    assert sum(found[i] == want[i] for i in linked) >= 0.98 * len(linked)


def test_hot_buckets_are_split(spark, monkeypatch):
    """A passage that many texts quote, with pairs among them that are alike."""
    monkeypatch.setattr(near_dup, "PAIRWISE", 8)
    r = random.Random(28)
    passage = words(r, 60)
    rows = []
    for i in range(150):
        own = words(r, 60)
        text = own[:30] + passage + own[30:]
        rows.append((2 * i, " ".join(text)))
        if i % 5 == 0:
            for _ in range(8):
                text[r.randrange(120)] = f"new{r.randrange(999)}"
            rows.append((2 * i + 1, " ".join(text)))
    found = {x["doc_id"]: x["class_id"] for x in near_dup.near_duplicates(frame(spark, rows)).collect()}
    assert found == classes(rows)


def test_pairs_at_the_limit_that_share_only_a_large_bucket(spark):
    """150 pairs of similarity exactly 0.8: all quote one passage, and all edits lie in their own 40 words."""
    r = random.Random(31)
    passage = words(r, 80)
    rows = []
    for i in range(150):
        own = [f"{w}{i}" for w in words(r, 40)]
        other = list(own)
        for k in r.sample(range(40), 24):
            other[k] = f"edit{r.randrange(10**9)}"
        rows += [(2 * i, " ".join(own[:20] + passage + own[20:])), (2 * i + 1, " ".join(other[:20] + passage + other[20:]))]
    found = {x["doc_id"]: x["class_id"] for x in near_dup.near_duplicates(frame(spark, rows)).collect()}
    assert found == {i: i - i % 2 for i in range(300)}


def test_long_pairs_at_the_limit_that_share_only_a_large_bucket(spark):
    """100 pairs of 500 words and similarity exactly 0.8: all quote one passage, and no run of five words of their own stays."""
    r = random.Random(33)
    passage = words(r, 375)
    rows = []
    for i in range(100):
        own = [f"{w}{i}" for w in words(r, 125)]
        other = [w if k % 5 == 2 else f"edit{r.randrange(10**9)}" for k, w in enumerate(own)]
        rows += [(2 * i, " ".join(own[:60] + passage + own[60:])), (2 * i + 1, " ".join(other[:60] + passage + other[60:]))]
    found = {x["doc_id"]: x["class_id"] for x in near_dup.near_duplicates(frame(spark, rows)).collect()}
    assert found == {i: i - i % 2 for i in range(200)}


def test_lists_of_rare_words_lose_no_pair(spark, monkeypatch):
    """Words so few that lists by one word are long, and rounds go on to a second and a third."""
    monkeypatch.setattr(near_dup, "PAIRWISE", 4)
    monkeypatch.setattr(near_dup, "sketches", lambda w, orders: near_dup.np.zeros(1, near_dup.np.int64))
    monkeypatch.setattr(near_dup, "deeper_sketches", lambda w, orders: (near_dup.np.zeros(1, near_dup.np.int64), near_dup.np.arange(2)[None, :] + len(w)))
    r = random.Random(32)
    rows = []
    for i in range(60):
        text = [f"w{r.randrange(60)}" for _ in range(r.randrange(12, 40))]
        rows.append((3 * i, " ".join(text)))
        for k in range(1, 1 + i % 3):
            changed = list(text)
            for _ in range(len(text) // 5):
                changed[r.randrange(len(text))] = f"w{r.randrange(60)}"
            rows.append((3 * i + k, " ".join(changed)))
    found = {x["doc_id"]: x["class_id"] for x in near_dup.near_duplicates(frame(spark, rows)).collect()}
    assert found == classes(rows)


@pytest.mark.parametrize("split", [0, 200])
def test_blocks_of_large_parts_lose_no_pair(spark, monkeypatch, split):
    """Parts of several blocks, in the first round (200) or in the last one of three (0)."""
    for name, value in (("PAIRWISE", 4), ("BLOCK", 5), ("FIRST", 2), ("SPLIT", split)):
        monkeypatch.setattr(near_dup, name, value)
    monkeypatch.setattr(near_dup, "sketches", lambda w, orders: near_dup.np.zeros(1, near_dup.np.int64))
    monkeypatch.setattr(near_dup, "deeper_sketches", lambda w, orders: (near_dup.np.zeros(1, near_dup.np.int64), near_dup.np.arange(2)[None, :] + len(w)))
    r = random.Random(34)
    rows = []
    for i in range(40):
        text = [f"w{r.randrange(40)}" for _ in range(r.randrange(12, 40))]
        rows.append((3 * i, " ".join(text)))
        for k in range(1, 1 + i % 3):
            changed = list(text)
            for _ in range(len(text) // 5):
                changed[r.randrange(len(text))] = f"w{r.randrange(40)}"
            rows.append((3 * i + k, " ".join(changed)))
    found = {x["doc_id"]: x["class_id"] for x in near_dup.near_duplicates(frame(spark, rows)).collect()}
    assert found == classes(rows)


def test_texts_that_share_many_rare_words_make_few_rows(spark, monkeypatch):
    """A passage, some of its words in another order in each text: each two texts share many listed words, few are alike."""
    r = random.Random(35)
    quoted, passage = words(r, 60), [f"p{k}" for k in range(160)]
    rows = []
    for i in range(100):
        own = quoted + [f"o{i}x{k}" for k in range(30)] + r.sample(passage, 160)
        rows.append((2 * i, " ".join(own)))
        if i % 10 == 0:
            rows.append((2 * i + 1, " ".join([*own[:-20], *(f"e{i}x{k}" for k in range(20))])))
    made, kept = {}, near_dup.kept

    def counted(few, df, name):
        out = kept(few, df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(near_dup, "kept", counted)
    found = {x["doc_id"]: x["class_id"] for x in near_dup.near_duplicates(frame(spark, rows)).collect()}
    assert found == {i: i - i % 2 for i, _ in rows}
    assert made["open"] <= made["rare-words"]


def test_pairs_of_a_block_are_those_that_bags_allow():
    r = np.random.default_rng(36)
    texts = [mix(r.integers(0, 30, n).astype(np.uint64)) for n in (10, 12, 30, 33, 34, 36, 40, 60, 64, 66, 70, 70) for _ in range(2)]
    bags, n, labels = [near_dup.bag_of(t) for t in texts], np.array([len(t) for t in texts]), r.integers(0, 5, len(texts))
    firsts = [r.permutation(6)[:2].tolist() for _ in texts]
    apart = near_dup.meet_before(firsts, 9)
    x, y = near_dup.pairs_of_block(np.arange(len(texts)), labels, n, bags, apart, 0.5)
    want = set()
    for i, j in combinations(range(len(texts)), 2):
        most = int(max(n[i], n[j]))
        assert apart[i, j] == bool(set(firsts[i]) & set(firsts[j]))
        if not apart[i, j] and labels[i] != labels[j] and min(n[i], n[j]) >= 0.5 * most and near_dup.common_at_most(bags[i], bags[j]) >= most - near_dup.edit_limit(most, 0.5):
            want.add((i, j))
    assert want and sorted(zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist(), strict=True)) == sorted(want)


def test_one_bag_of_words_in_many_orders_makes_no_rows_of_pairs(spark, monkeypatch):
    """All texts have the same words, so bags tell none apart, and nearly all pairs fail when they are aligned."""
    monkeypatch.setattr(near_dup, "sketches", lambda w, orders: near_dup.np.zeros(1, near_dup.np.int64))
    r = random.Random(37)
    rows, own = [], [f"w{k}" for k in range(30)]
    for i in range(90):
        text = r.sample(own, 30)
        rows.append((2 * i, " ".join(text)))
        if i % 9 == 0:
            rows.append((2 * i + 1, " ".join([*text[:12], f"e{i}", *text[13:]])))
    made, kept = {}, near_dup.kept

    def counted(few, df, name):
        out = kept(few, df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(near_dup, "kept", counted)
    found = {x["doc_id"]: x["class_id"] for x in near_dup.near_duplicates(frame(spark, rows)).collect()}
    assert found == classes(rows)
    assert max(made[name] for name in ("pairs", "hopeful", "links")) <= 6 * len(rows)  # 4950 pairs


def test_pairs_of_small_parts_are_those_that_bitmaps_and_bags_allow():
    r = np.random.default_rng(38)
    texts = [mix(r.integers(0, 40, n).astype(np.uint64)) for n in (10, 12, 30, 33, 34, 36, 40, 60, 64, 66, 70, 70) for _ in range(4)]
    docs = np.repeat(np.arange(len(texts)), 2)  # each lies in two parts
    parts = np.concatenate([r.permutation(5)[:2] for _ in texts])
    firsts = [sorted(parts[docs == d].tolist()) for d in docs]
    bags, bits, n = [near_dup.bag_of(t) for t in texts], np.stack([near_dup.bitmap_of(t) for t in texts]), np.array([len(t) for t in texts])
    labels = r.integers(0, 8, len(texts))
    x, y = near_dup.pairs_of_small_parts(parts, docs, labels[docs], n[docs], bits[docs], [bags[d] for d in docs], firsts, 0.5)
    assert (parts[x] == parts[y]).all()
    want = set()
    for i, j in combinations(range(len(texts)), 2):
        most = int(max(n[i], n[j]))
        edits = near_dup.edit_limit(most, 0.5)
        few_bits = np.unpackbits((bits[i] ^ bits[j]).view(np.uint8)).sum() <= 2 * edits
        if set(parts[docs == i]) & set(parts[docs == j]) and labels[i] != labels[j] and min(n[i], n[j]) >= 0.5 * most and few_bits and near_dup.common_at_most(bags[i], bags[j]) >= most - edits:
            want.add((i, j))
    assert want and sorted(zip(np.minimum(docs[x], docs[y]).tolist(), np.maximum(docs[x], docs[y]).tolist(), strict=True)) == sorted(want)


def test_bags_bound_the_words_in_common():
    r = np.random.default_rng(29)
    for _ in range(500):
        n = int(r.integers(1, 300))
        m = int(r.integers(max(1, int(n * 0.8)), int(n * 1.25) + 1))
        x, y = (mix(r.integers(0, int(r.integers(2, 400)), k).astype(np.uint64)) for k in (n, m))
        common = sum((collections.Counter(x.tolist()) & collections.Counter(y.tolist())).values())
        assert common <= near_dup.common_at_most(near_dup.bag_of(x), near_dup.bag_of(y))


def test_an_edit_changes_two_bits_at_most():
    r = np.random.default_rng(30)
    for _ in range(500):
        words = r.integers(0, int(r.integers(2, 400)), int(r.integers(0, 300))).tolist()
        changed, edits = list(words), int(r.integers(0, 40))
        for _ in range(edits):
            at, kind = int(r.integers(0, len(changed) + 1)), int(r.integers(0, 3))
            changed[at : at + (kind > 0)] = [int(r.integers(0, 400))] * (kind < 2)
        x, y = (near_dup.bitmap_of(mix(np.array(t, np.uint64))) for t in (words, changed))
        assert len(x) == near_dup.BITS // 64
        assert np.unpackbits((x ^ y).view(np.uint8)).sum() <= 2 * edits


COLUMNS = {
    "op1_line_dedup": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    "op2_lm_scoring": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op4_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op5_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op7_topk_search": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op8_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op10_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op11_hard_negatives": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
    "op12_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op13_lexical_search": "item_id bigint, rank int, doc_id bigint, score bigint",
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_queries(spark, name):
    found = queries.QUERIES[name](spark, SF)
    types = {f.name: f.dataType.simpleString() for f in found.schema.fields}
    for column in COLUMNS.get(name, "doc_id bigint").split(", "):
        column, kind = column.split()
        assert types[column] == kind
    table = "pages" if name == "op4_url_filter" else "documents"
    rows = found.toPandas()
    if name not in ("op7_topk_search", "op10_packing", "op11_hard_negatives", "op13_lexical_search"):
        assert len(rows) == queries.table(spark, SF, table).count()
    if name == "op5_pii":
        texts = dict(queries.table(spark, SF, "documents").select("doc_id", "text").collect())
        for x in rows.itertuples():
            spans = [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(texts[x.doc_id] or "")]
            line = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
            assert x.base_sha256 == __import__("hashlib").sha256(line.encode()).hexdigest()
    if name == "op4_url_filter":
        assert set(rows["verdict"]) <= {"allow", "block"}


def test_pipeline_runs_whole(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF).toPandas()
    assert isinstance(out, pd.DataFrame) and len(out)
    whole = out.groupby("doc_id").agg(n=("length", "sum"), want=("doc_tokens", "first"))
    assert (whole["n"] == whole["want"]).all()
    assert out.groupby("sequence_id")["length"].sum().max() <= 2048
