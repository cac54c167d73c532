"""Benchmark leaks in any script and of any length, against a plain table of edit distances."""

from __future__ import annotations

import random

import numpy as np

from fieldloom.llm import decontamination as D
from fieldloom.llm.common import word_hashes


def words_of(text):
    """By the definition: characters one by one."""
    out, run = [], ""
    for c in text or "":
        code = ord(c)
        gone = c.isspace() and code < 128 or code < 128 and not c.isalnum() and code > 32 or any(a <= code <= b for a, b in D.SEPARATORS) or c == " "
        alone = any(a <= code <= b for a, b in D.UNSPACED)
        if gone or alone:
            out, run = out + [run] * bool(run) + [c] * (alone and not gone), ""
        else:
            run += c.lower() if code < 128 else c
    return out + [run] * bool(run)


def least_edits(item, text):
    """The least edit distance of the item to any run of the text, by the whole table."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_words_are_those_of_the_definition():
    texts = ["", "one two", "北京是中国的首都。人口，两千万！", "ab漢字cd「か」e", "ภาษาไทย ok", "«Été» à Paris… “yes”—no", "a b", "𠀀𠀁x", "Ａ，Ｂ", "x\t\r\ny\x0bz", "한국어 문장", "!!!", "a-b_c", "é", "漢"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    starts = np.append(0, np.cumsum([len(t.encode()) for t in texts]))
    _, bounds = word_hashes(data, starts, D.tables(), D.split)
    assert np.diff(bounds).tolist() == [len(words_of(t)) for t in texts]
    alone = [word_hashes(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), D.tables(), D.split)[0].tolist() if t else [] for t in texts]
    known = {}
    for t, hashes in zip(texts, alone, strict=True):
        for w, h in zip(words_of(t), hashes, strict=True):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def test_leaks_in_scripts_without_spaces_and_short_items(spark):
    r = random.Random(1)
    han = [chr(0x4E00 + k) for k in range(300)]
    latin = ["".join(r.choices("abcdefgh", k=5)) for _ in range(80)]
    items = [(1, "".join(r.choices(han, k=24))), (2, "".join(r.choices(han, k=8)) + "，" + "".join(r.choices(han, k=9)) + "。"), (3, " ".join(r.choices(latin, k=14))), (4, "uniqueword"), (5, "two words"), (6, "three little words"), (7, "字典"), (8, "。，"), (9, "ไทยแลนด์ดินแดนแห่งรอยยิ้ม")]
    docs = []
    for k in range(80):
        item = items[k % 9][1]
        part = list(item) if k % 9 in (0, 1, 8) else item.split()
        for _ in range(r.choice([0, 0, 1, 2, 4, 6])):
            part[r.randrange(len(part))] = r.choice(han) if k % 9 in (0, 1) else "edited"
        joined = ("" if k % 9 in (0, 1, 6, 8) else r.choice([" ", ", ", "—"])).join(part)
        before, after = "".join(r.choices(han, k=30)) + "，", "。" + " ".join(r.choices(latin, k=20))
        docs.append((k, before + joined + after))
    docs += [(100, "says UniqueWord!"), (101, "uniqueword2"), (102, "three little, words"), (103, "three big words"), (104, "这是字典。"), (105, None), (106, "")]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {x["doc_id"]: {y["item_id"]: y["distance"] for y in x["leaks"]} for x in D.find_leaks(frame, bench).collect()}
    want = {}
    for i, text in docs:
        want[i] = {}
        for j, item in items:
            p = words_of(item)
            e = int(0.2 * len(p) + 1e-9)
            if p and (d := least_edits(p, words_of(text))) <= e:
                want[i][j] = d
    assert {i: set(v) for i, v in got.items()} == {i: set(v) for i, v in want.items()}
    assert all(want[i][j] <= got[i][j] for i in got for j in got[i])
    assert {1, 2, 3, 4, 5, 6, 7, 9} <= {j for v in got.values() for j in v} and got[100] == {4: 0} and got[101] == {} and got[104] == {7: 0}
