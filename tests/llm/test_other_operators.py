"""Packing, top-k search, url rules, and the registered queries."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import packing, queries, topk_search, url_filter

tokenizers = pytest.importorskip("tokenizers")


def test_packing_is_whole_and_tight(spark):
    r = random.Random(1)
    pool = ["Hello", "world.", "it's", "naïve", "ÉTÉ", "x1y2", "...", "don't!", "<|endoftext|>", "漢字", "a\xa0b", "été,", "ThE"]
    rows = [(i, " ".join(r.choices(pool, k=r.randrange(0, 900)))) for i in range(60)] + [(60, None), (61, ""), (62, "word " * 6000), (None, "no id"), (5, "repeated id")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, length int")
    got = packing.pack(docs, queries.tokenizer_path(), with_ids=True).collect()
    whole = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    want = sorted(tuple(whole.encode(t or "", add_special_tokens=False).ids + [1]) for _, t in rows)
    texts, pieces = [], {}
    for x in got:
        assert zlib.crc32(np.array(x["ids"], "<u4").tobytes()) == x["ids_crc32"]
        assert len(x["ids"]) == x["length"] <= 2048
        pieces.setdefault((x["doc_id"], x["doc_tokens"]), []).append(x)
    for parts in pieces.values():
        parts.sort(key=lambda x: x["start"])
        texts.append(tuple(i for x in parts for i in x["ids"]))
    assert sorted(texts) == want
    by_sequence = {}
    for x in got:
        by_sequence.setdefault(x["sequence_id"], []).append(x)
    for parts in by_sequence.values():
        at = 0
        for x in sorted(parts, key=lambda x: x["offset"]):
            assert x["offset"] == at
            at += x["length"]
        assert at == parts[0]["sequence_tokens"] <= 2048
    total = sum(x["length"] for x in got)
    assert len(by_sequence) <= -(-total // 2048) + 5
    assert packing.pack(docs.limit(0), queries.tokenizer_path()).collect() == []


def test_cutting_stock_holds_the_demand_exactly():
    r = random.Random(2)
    for _ in range(40):
        demand = {r.randrange(1, 33): r.randrange(1, 50) for _ in range(r.randrange(1, 12))}
        plan, held = packing.cutting_stock(demand, 32), {}
        for pattern, times in plan:
            assert sum(k * n for k, n in pattern.items()) <= 32
            for k, n in pattern.items():
                held[k] = held.get(k, 0) + n * times
        assert held == demand
        first_fit = []
        for size in sorted((k for k, n in demand.items() for _ in range(n)), reverse=True):
            for b in range(len(first_fit)):
                if first_fit[b] + size <= 32:
                    first_fit[b] += size
                    break
            else:
                first_fit.append(size)
        assert sum(t for _, t in plan) <= len(first_fit) + 2
    assert packing.cutting_stock({}, 32) == []


def test_topk_equals_brute_force(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=8).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)] + [(400, None), (401, [1.0, float("nan")]), (402, [None, 1.0]), (403, [0.5]), (None, [1.0] * 8), (404, [float("inf")] * 8), (405, []), (1005, rows[9][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    ok = [(i, np.floor(1024 * np.pad(np.array(v), (0, 8 - len(v)))).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    queries_ = df.where("vec_id % 50 = 0")
    for size in (1 << 25, 200):
        got = {}
        for x in topk_search.search(df, queries_, 10, slice_bytes=size).collect():
            got.setdefault(x["query_id"], []).append((x["rank"], -x["score"], x["vec_id"]))
        for q, v in ok:
            if q % 50 == 0:
                want = sorted((-int(u @ v), i) for i, u in ok if i != q)[:10]
                assert [(s, i) for _, s, i in sorted(got.pop(q))] == want
        assert not got
    big = spark.createDataFrame([(0, [1e9, 1e9]), (1, [1e9, 1e9 + 1]), (2, [1e9, 1e9])], "vec_id long, embedding array<double>")
    found = topk_search.search(big, big.where("vec_id = 0"), 1, scale=1).first()
    assert (found["vec_id"], found["score"]) == (1, 2 * 10**18 + 10**9)
    assert topk_search.search(df.limit(0), queries_, 3).collect() == []
    assert topk_search.search(df, df.limit(0), 3).collect() == []


def test_url_rules(spark):
    urls = [
        "http://a.com/x", "http://example.com/en/1", "https://WWW.Example.com/en/2?a=b", "http://shop.example.net/es/3#f", "http://x.net/en", None, "no scheme",
        "http://notexample.com", "http://example.com/en", "ftp://u.example.com?q", "http://a.com/x", "http://net/fr/", "x://", "http://a.com.evil.org/x",
    ]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rules = spark.createDataFrame(queries.URL_RULES, "action string, rule string")

    def brute(u):
        if u is None or "://" not in u:
            return "", "", None, "allow"
        rest = u.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = rest[:cut], rest[cut:]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
        fits = [(len(t), t, a) for a, t in queries.URL_RULES for h, p in [t.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        best = max(fits, default=None)
        return host, path, best and best[1], best[2] if best else "allow"

    got = {x["page_id"]: (x["host"], x["path"], x["rule"], x["verdict"]) for x in url_filter.judge_urls(pages, labels, rules).collect()}
    assert got == {i: brute(u) for i, u in enumerate(urls)}
    assert url_filter.judge_urls(pages.limit(0), labels, rules).collect() == []


def test_mined_rules_block_what_labels_say(spark):
    pages = spark.createDataFrame([(i, f"http://{'spam' if i % 3 == 0 else 'good'}{i}.site.org/{'win' if i % 3 == 0 else 'read'}/{i}") for i in range(90)], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(60)] + [(61, None, None)], "doc_id long, quality int, toxic int")
    got = url_filter.judge_urls(pages, labels, spark.createDataFrame([], "action string, rule string")).collect()
    assert all((x["verdict"] == "block") == (x["page_id"] % 3 == 0) for x in got)
    tokens = [(["/win"], "block", 0.9, 0.2), (["/win", ".org"], "block", 0.8, 0.1)]
    rules = spark.createDataFrame(tokens, "tokens array<string>, action string, confidence double, support double")
    judged = url_filter.mined_verdicts(url_filter.distinct_urls(pages), rules)
    assert judged.count() == 30 and {x["mined"] for x in judged.collect()} == {"block"}


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_pipeline_stages(spark):
    import corpus_pipeline

    r = random.Random(4)
    sentence = lambda n: " ".join(r.choice(["amber", "birch", "cedar", "delta", "ember", "frost", "grove", "heath"]) + str(r.randrange(60)) for _ in range(n))
    base, passage, line = sentence(80), sentence(25), "This line is repeated by many documents."
    rows = [(i, f"{sentence(60)}\n{line}", "en") for i in range(5)] + [(10, base, "en"), (11, base + " end", None), (12, f"{sentence(20)} {passage} {sentence(20)}", "en"), (13, "123 !!", "en"), (14, None, "en")]
    docs = spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["language ID", "line dedup", "near dedup", "decontamination", "packing"]
    out = stage["language ID"](spark, docs, "")
    assert {x["doc_id"] for x in out.collect()} == {0, 1, 2, 3, 4, 10, 11, 12}
    out = stage["line dedup"](spark, out, "")
    assert sorted(x["doc_id"] for x in out.where(F.col("text").contains("repeated by many")).collect()) == [4]
    out = stage["near dedup"](spark, out, "")
    assert {x["doc_id"] for x in out.collect()} == {0, 1, 2, 3, 4, 10, 12}
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language_stage_drops_texts_of_no_language(spark):
    import corpus_pipeline

    rows = [(i, f"the quick brown fox number {i} jumps over the lazy dog", "en", "s", 1) for i in range(20)]
    rows += [(50, "the lazy dog jumps", None, "s", 1), (51, "\u0436\u0449\u044f \u044e\u0444\u044d", None, "s", 1), (52, "12 34", None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {x["doc_id"]: x["lang"] for x in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert kept == {**{i: "en" for i in range(20)}, 50: "en"}
