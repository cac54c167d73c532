from __future__ import annotations

import numpy as np
import pytest

from fieldloom.llm import line_dedup as L

SCHEMA = "doc_id long, text string, h1 string, shard string"
LONG = "a line that is surely long enough"


def brute(rows, min_docs=3, min_chars=20):
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    key = lambda s: low(s.strip(" \t\n\v\f\r"))
    docs = {}
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= min_chars:
                    docs.setdefault(key(line), set()).add(i)
    drop = {k: max(v) for k, v in docs.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or drop.get(key(x), i) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


ROWS = [
    (1, f"{LONG}\nown words of one"), (2, f"  {LONG.upper()}\t\n{LONG}\nmore"), (3, f"{LONG}\n{LONG}"), (4, "short\nshort\nshort"), (5, "short"), (6, "short"),
    (7, None), (8, ""), (9, "éééééééééééééééééééé"), (10, "éééééééééééééééééééé\n"), (11, "éééééééééééééééééééé"), (12, "ééééééééééééééééééé"),
    (13, "É" * 20), (13, LONG), (None, LONG), (2, f"  {LONG.upper()}\t\n{LONG}\nmore"), (14, "x" * 100_000 + "\n" + LONG),
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in ROWS], SCHEMA)


def result(df):
    return sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in df.collect()), key=str)


def test_equals_brute_force(docs):
    assert result(L.dedup_lines(docs)) == brute(ROWS)


def test_empty_table(spark):
    assert result(L.dedup_lines(spark.createDataFrame([], SCHEMA))) == []


def test_insert_and_delete_equal_a_fresh_build(spark, docs):
    ids = docs.where("doc_id IS NOT NULL")
    index = L.LineIndex.build(ids.where("doc_id < 3")).insert(ids.where("doc_id >= 3")).insert(ids.where("doc_id = 1"))
    assert result(index.scrub(docs)) == brute(ROWS)
    index = index.delete(ids.where("doc_id IN (3, 14)").select("doc_id"))
    left = [r for r in ROWS if r[0] not in (3, 14)]
    assert result(index.scrub(docs.where("doc_id IS NULL OR doc_id NOT IN (3, 14)"))) == brute(left)
    fresh = L.LineIndex.build(ids.where("doc_id NOT IN (3, 14)"))
    assert sorted(map(str, index.references.collect())) == sorted(map(str, fresh.references.collect()))


def test_cuckoo_filter_inserts_finds_and_deletes():
    r = np.random.default_rng(1)
    h = r.integers(1, 2**63, 5000, dtype=np.uint64)
    f = L.CuckooFilter(len(h))
    assert f.insert(h)
    assert f.contains(h).all()
    assert f.contains(r.integers(1, 2**63, 20_000, dtype=np.uint64)).mean() < 0.01
    f.delete(h[:2500])
    assert f.contains(h[2500:]).all()
    assert f.contains(h[:2500]).mean() < 0.01
    assert not L.CuckooFilter(4).insert(np.arange(1, 200, dtype=np.uint64))
