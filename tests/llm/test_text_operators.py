"""Scoring, leaks, near copies, languages, quality and personal data against brute force and on edge cases."""

from __future__ import annotations

import collections
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from fieldloom.llm import decontamination as D
from fieldloom.llm import langid, near_dup, pii, quality, queries
from fieldloom.llm import lm_scoring as LM

SCHEMA = "doc_id long, text string, lang string, block string, label string"
EDGE = [(900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "word " * 30_000), (None, "a text without an id but with words")]


def words(r, n, vocabulary=400):
    return [f"w{min(int(r.expovariate(0.01)), vocabulary)}" for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "b", "l") for i, t in rows], SCHEMA)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_and_bit_parallel_distances():
    r = random.Random(1)
    for _ in range(1500):
        a = [r.randrange(4) for _ in range(r.randrange(12))]
        b = list(a) if r.random() < 0.5 else [r.randrange(4) for _ in range(r.randrange(12))]
        for _ in range(r.randrange(3)):
            b.insert(r.randrange(len(b) + 1), r.randrange(4))
        d = edits(a, b)
        for most in (0, 1, 3, 20):
            assert near_dup.edits_within(a, b, most) == (d if d <= most else None)
        if a:
            assert D.myers(a, b)[0] == min(edits(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))


def test_near_duplicates(spark):
    r = random.Random(2)
    rows, group = [], {}
    for g in range(25):
        base = words(r, 200)
        for k in range(4):
            copy = list(base)
            if k > 1:
                copy[r.randrange(200)] = "changed"
            rows.append((10 * g + k, " ".join(copy) if k != 1 else "\n".join(copy).upper()))
            group[10 * g + k] = 10 * g
    rows.append((3, rows[3][1]))
    got = near_dup.near_duplicates(frame(spark, rows + EDGE)).collect()
    found = {x["doc_id"]: x["class_id"] for x in got}
    assert {k: v for k, v in found.items() if k < 900} == group
    assert all(found[k] == k for k in range(900, 905))
    assert sum(x["kept"] for x in got) == 25 + 5
    assert {x["class_size"] for x in got if x["doc_id"] < 900} == {4}
    assert near_dup.near_duplicates(frame(spark, [])).collect() == []


def test_near_duplicates_of_a_large_group(spark):
    r = random.Random(7)
    base = words(r, 120)
    rows = []
    for i in range(300):
        copy = list(base)
        copy[r.randrange(120)] = f"own{i}"
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, " ".join(words(r, 60) + base[:30] + words(r, 60))) for i in range(100)]
    found = {x["doc_id"]: x["class_id"] for x in near_dup.near_duplicates(frame(spark, rows)).collect()}
    assert {found[i] for i in range(300)} == {0}
    assert all(found[1000 + i] == 1000 + i for i in range(100))


def test_batches_are_small_while_near_duplicates_runs(spark):
    from fieldloom.llm import common

    name, df = "spark.sql.execution.arrow.maxBytesPerBatch", spark.range(0, 4000, 1, 1).selectExpr("repeat('x', 10000) AS text")
    before = spark.conf.get(name)

    def sizes(batches):
        yield from (common.pa.RecordBatch.from_arrays([common.pa.array([b.nbytes])], names=["n"]) for b in batches)

    with common.small_batches(spark):
        assert max(r["n"] for r in df.mapInArrow(sizes, "n long").collect()) < 9 << 20
    assert spark.conf.get(name) == before
    whole = common.pa.RecordBatch.from_arrays([common.pa.array(["x" * 1000] * 100)], names=["text"])
    assert [b.num_rows for b in common.slices([whole, whole.slice(0, 0)], 10_000)] == [9] * 11 + [1]


def test_tasks_give_back_what_they_have_freed():
    """Blocks that lie below one still held stay with the process unless they are given back."""
    from fieldloom.llm import common

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    held = []

    def run(batches):
        for batch in batches:
            blocks = [near_dup.np.ones(6_000) for _ in range(4_000)]  # 48 kB each
            held.append(blocks[-1])
            yield batch

    before = resident()
    assert list(common.giving_back(run)([1])) == [1]
    assert resident() - before < 60 << 20  # of 192 MB


def test_near_duplicates_begins_without_rdds_of_python(spark, monkeypatch):
    docs = frame(spark, [(1, "a b c"), (2, "a b c"), (3, "d")])
    monkeypatch.setattr(type(spark), "createDataFrame", None)
    assert {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}


def classes(rows):
    """doc_id -> smallest id of its class, by all pairs."""
    label = {i: i for i, _ in rows}
    for k, (i, x) in enumerate(rows):
        for j, y in rows[:k]:
            x_, y_ = x.split(), y.split()
            n = max(len(x_), len(y_))
            if n and edits(x_, y_) <= int(0.2 * n + 1e-9):
                low, high = sorted((label[i], label[j]))
                label = {d: low if c == high else c for d, c in label.items()}
    return label


def test_every_class_of_a_bucket_is_tried(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "sketches", lambda w, orders: near_dup.np.zeros(min(len(w), 1), near_dup.np.int64))
    r = random.Random(11)
    rows = []
    for family in range(2):  # chains of drifting copies, their ids interleaved; a text is like its neighbours only
        text = [f"f{family}w{k}" for k in range(30)]
        for k in range(20):
            rows.append((2 * k + family, " ".join(text)))
            for at in r.sample(range(30), 5):
                text[at] = f"f{family}c{k}at{at}"
    rows += [(100 + k, " ".join(f"own{k}w{j}" for j in range(30))) for k in range(5)]
    r.shuffle(rows)
    want = classes(rows)
    found = {x["doc_id"]: x["class_id"] for x in near_dup.near_duplicates(frame(spark, rows)).collect()}
    assert found == want and set(want.values()) == {0, 1, *range(100, 105)}


def test_short_texts_equal_brute_force(spark):
    r = random.Random(12)
    rows = []
    for g in range(40):
        base = [f"g{g}w{k}" for k in range(r.randrange(1, 13))]
        for _ in range(4):
            copy = list(base)
            for _ in range(r.randrange(4)):
                at, kind = r.randrange(len(copy) + 1), r.randrange(3)
                copy[at : at + (kind > 0)] = ["new"] if kind < 2 else []
            if 0 < len(copy) <= 12:
                rows.append((len(rows), " ".join(copy)))
    found = {x["doc_id"]: x["class_id"] for x in near_dup.near_duplicates(frame(spark, rows)).collect()}
    assert found == classes(rows)


def test_leaks(spark):
    r = random.Random(3)
    items = [(i, " ".join(words(r, n))) for i, n in enumerate((30, 12, 45, 5))] + [(8, None), (9, ""), (10, "too few words"), (0, "Repeated item, its id: also twice!")]
    rows, want = [], {}
    for k in range(60):
        text, hit = words(r, 80), set()
        if k % 2:
            i = k % 4
            passage = items[i][1].split()
            budget = int(0.2 * len(passage))
            for _ in range(r.randrange(budget + 1)):
                passage[r.randrange(len(passage))] = "edit"
            text[40:40] = passage
            hit = {i}
        rows.append((k, " ".join(text)))
        want[k] = hit
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, rows + EDGE)

    def brute(text, item):
        p, t = (re.findall(r"[^\W_]+", x.lower()) for x in (item, text))
        e = int(0.2 * len(p) + 1e-9)
        return len(p) >= 5 and D.myers(p, t)[0] <= e

    got = {x["doc_id"]: {y["item_id"] for y in x["leaks"]} for x in D.find_leaks(docs, bench).collect()}
    for k, text in rows:
        assert got[k] == {i for i, t in items if t and brute(text, t)}
        assert want[k] <= got[k]
    sliced = {x["doc_id"]: {y["item_id"] for y in x["leaks"]} for x in D.find_leaks(docs, bench, slice_bytes=100).collect()}
    assert sliced == got
    assert not any(x["contaminated"] for x in D.find_leaks(docs, bench.limit(0)).collect())
    assert D.find_leaks(frame(spark, []), bench).collect() == []


def test_language_model_scores(spark):
    r = random.Random(4)
    rows = [(i, " ".join(words(r, r.randrange(1, 60)))) for i in range(120)]
    everything = rows + EDGE[:5]
    docs = frame(spark, everything)
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    got = {x["doc_id"]: x for x in LM.score_texts(docs, train, block_bytes=4000).collect()}
    tokens = {i: (t or "").lower().split() + ["</s>"] for i, t in everything}
    c = collections.Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in tokens.items():
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(t), sum(c[w] > 0 for w in t), n)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
    one_block = {x["doc_id"]: x["score"] for x in LM.score_texts(docs, train).collect()}
    held = [i for i, _ in rows if got[i]["held_out"]]
    assert sum(got[i]["score"] for i in held) > sum(got[i]["base_score"] for i in held)
    assert sum(one_block[i] for i in held) == pytest.approx(sum(got[i]["score"] for i in held), rel=0.05)
    assert [x["score"] for x in LM.score_texts(docs.limit(1), F.lit(False)).collect()] == [0.0]
    assert LM.score_texts(frame(spark, []), train).collect() == []


def test_weights_follow_the_held_out_counts():
    """EM finds the mixture that makes held-out counts likeliest; octaves without any keep what they start with."""
    import numpy as np
    import pandas as pd

    r = np.random.default_rng(1)
    pair, word = r.uniform(0, 40, 4000), r.uniform(0, 40, 4000)
    true = np.array([0.6, 0.3, 0.1])
    n = pair * true[0] + word * true[1] + true[2]  # events in proportion to their probability under the true mixture
    held = pd.DataFrame({"octave": 3, "pair": LM.steps(pair), "word": LM.steps(word), "n": n * 50})
    weights = LM.learn_weights(held)
    assert weights.sum(axis=1) == pytest.approx(1)
    x = weights[3]

    def likelihood(w):
        return (held["n"] * np.log(w[0] * pair + w[1] * word + w[2])).sum()

    others = r.dirichlet([1, 1, 1], 200)
    assert likelihood(x) >= max(map(likelihood, others)) - 1e-3 * abs(likelihood(x))
    assert weights[4] == pytest.approx([0.4, 0.4, 0.2])
    only = pd.DataFrame({"octave": [2, 2], "pair": [-32768, -32768], "word": [40, 44], "n": [500, 500]})
    assert LM.learn_weights(only)[2][1] > 0.95


def test_languages(spark):
    r = random.Random(5)
    sounds = {"aa": ["ka", "ta", "mo"], "bb": ["lü", "sche", "ng"], "cc": ["ñe", "cio", "ll"]}
    rows = [(i, " ".join("".join(r.choices(sounds[g], k=3)) for _ in range(40)), g) for i, g in enumerate(list(sounds) * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs.where("doc_id % 4 <> 2"))
    got = {x["doc_id"]: x for x in langid.identify(docs, model).collect()}
    assert all(got[i]["lang_pred"] == g for i, _, g in rows)
    assert all(0 < x["score"] <= 1 for x in got.values())
    odd = langid.identify(spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !"), (4, "漢字"), (None, "kata")], "doc_id long, text string"), model).collect()
    assert [x["lang_pred"] for x in sorted(odd, key=lambda x: x["doc_id"] or 99)][:3] == ["und"] * 3
    assert next(x for x in odd if x["doc_id"] == 4)["lang_pred"] in sounds
    nothing = langid.learn(docs.limit(0))
    assert {x["lang_pred"] for x in langid.identify(docs.limit(5), nothing).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).collect() == []


def test_quality(spark):
    r = random.Random(6)
    rows = [(i, " ".join(words(r, 50, 60))) for i in range(120)] + [(500 + i, "".join(r.choices("!#%&$xQZ", k=200))) for i in range(5)] + [(600, None), (601, "")]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(110)] + [(500, 0, 0), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    a = {x["doc_id"]: x for x in quality.judge_quality(docs, labels).collect()}
    b = {x["doc_id"]: x for x in quality.judge_quality(docs, labels, broadcast=0).collect()}
    assert all(not a[500 + i]["kept"] for i in range(5))
    assert sum(a[i]["kept"] for i in range(120)) > 110
    assert a[600]["perplexity"] is None and not a[601]["kept"]
    assert all(a[i]["perplexity"] == pytest.approx(b[i]["perplexity"]) for i, t in rows if t)
    free = quality.judge_quality(docs, labels.limit(0)).collect()
    assert all(x["kept"] for x in free if x["doc_id"] < 600)


def test_personal_data(spark):
    r = random.Random(8)
    letters = "ab1.@@-%ñ A"
    for _ in range(3000):
        t = "".join(r.choice(letters) for _ in range(r.randrange(30)))
        expression = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
        assert pii.emails(t) == [m.span() for m in re.finditer(expression, t)]
    assert [k for k, *_ in pii.base_spans("1.2.3.4, 1.2.3.999, 4111 1111 1111 1111, 4111111111111112, +1 (724) 555-7058")] == [1, 2, 3]
    filler = ["lorem", "ipsum", "dolor", "amet"]
    rows = [(i, " ".join(r.choices(filler, k=8)) + f" reach me at user{i}@mail.example.com now " + " ".join(r.choices(filler, k=5))) for i in range(40)]
    rows += [(100, "lorem reach me at john(at)mail77 now dolor"), (101, "amet serial code AB12345678 dolor"), (102, None), (103, ""), (104, "x1" * 20_000)]
    got = {x["doc_id"]: x for x in pii.find_personal_data(frame(spark, rows)).collect()}
    assert [tuple(s) for s in got[100]["added"]] == [(0, 18, 32)]
    assert not any(got[i]["added"] for i in range(101, 105))
    assert all(len(got[i]["spans"]) == 1 for i in range(40))
    assert pii.find_personal_data(frame(spark, [])).collect() == []


def test_counts_of_each_kind(spark, tmp_path):
    texts = ["a@b.co and c@d.example.org", "1.2.3.4", "call +1 (724) 555-7058", "a@b.co, 1.2.3.4, 5.6.7.8 and 4111 1111 1111 1111", "none", None]
    frame(spark, list(enumerate(texts))).write.parquet(str(tmp_path / "documents.parquet"))
    got = {x["doc_id"]: (x["n_email"], x["n_ip"], x["n_card"], x["n_phone"]) for x in queries.op5_pii(spark, str(tmp_path)).collect()}
    assert got == {0: (2, 0, 0, 0), 1: (0, 1, 0, 0), 2: (0, 0, 0, 1), 3: (1, 2, 1, 0), 4: (0, 0, 0, 0), 5: (0, 0, 0, 0)}


def test_a_context_among_many_other_seeds(spark):
    r = random.Random(9)
    rows = [(i, " ".join(words(r, 2) + [f"user{i}@mail.example.com"] + words(r, 2))) for i in range(51_000)]
    rows += [(60_000 + i, f"lorem reach me at host{i}@mail.example.com now dolor") for i in range(10)]
    rows += [(70_000, "lorem reach me at john(at)mail77 now dolor")]
    rows += [(80_000 + i, "the same footer asks contact office@firm.example.com for more") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    added = {x["doc_id"]: [tuple(s) for s in x["added"]] for x in pii.find_personal_data(docs).collect() if x["added"]}
    assert added == {70_000: [(0, 18, 32)]}


def test_pattern_counts_that_are_handed_on_in_parts_add_up(spark, monkeypatch):
    docs = frame(spark, [(i, "reach me at john now " * 3) for i in range(200)])
    found = pii.search_texts(frame(spark, [(1, "reach me at a@b.example.com now reach")]))
    patterns = found.select(F.explode("mentions").alias("m")).select(F.explode("m.patterns").alias("pattern"))
    want = sorted(map(tuple, pii.pattern_totals(docs, patterns).collect()))
    monkeypatch.setattr(pii, "HELD", 1)
    assert sorted(map(tuple, pii.pattern_totals(docs, patterns).collect())) == want
    assert sorted(n for _, n in want) == [400, 600, 600]  # the last of three has no word after "now"


def test_quality_learns_from_all_trusted_texts(spark, monkeypatch):
    ids = spark.range(28_000)
    docs = ids.selectExpr("id AS doc_id", "concat('text ', id) AS text", "'en' AS lang")
    labels = ids.selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    seen, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda texts: seen.append(texts.count()) or fit(texts.limit(100)))
    quality.judge_quality(docs, labels)
    assert seen == [sum(zlib.crc32(str(i).encode()) % 4 != 0 for i in range(28_000))] and seen[0] > 20_000


def test_counts_of_grams_that_are_handed_on_in_parts_add_up(spark, monkeypatch):
    docs = frame(spark, [(i, f"the {i % 7} quick brown foxes") for i in range(60)]).repartition(3)
    want = sorted(map(tuple, quality.count_grams(docs).collect()))
    monkeypatch.setattr(quality, "HELD", 1)
    assert sorted(map(tuple, quality.count_grams(docs).collect())) == want
