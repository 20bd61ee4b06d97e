import random

import numpy as np
import pyarrow as pa

from loomstone.llm import leakage

DOC = "doc_id long, text string, item_id string"
ITEM = "item_id long, text string, doc_id string"
WORDS = [f"{a}{b}" for a in ("bor", "kel", "wex", "tri", "mun", "sal", "dor", "fen") for b in ("ram", "lis", "toth", "vane", "guck", "pim", "zedd", "olo")]


def passage(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def test_leaks_whole_part_reordered_edited_and_not(spark):
    r = random.Random(1)
    item = ". ".join(passage(r, 14) for _ in range(4)) + "."
    parts = item.split(". ")
    filler = lambda: passage(r, 60)
    edited = item.replace(parts[1].split()[3], "xx", 1).upper().replace(" ", "  ")
    docs = [
        (1, filler() + " " + item + filler(), ""),
        (2, filler() + parts[2] + filler() + parts[0] + "\n" + parts[3], ""),
        (3, filler() + edited, ""),
        (4, filler() + parts[1][:60] + filler(), ""),
        (5, filler(), ""),
        (6, None, ""),
        (7, "", ""),
        (1, item, ""),
        (8, "é" * 70_000 + item, None),
    ]
    items = [(10, item, ""), (11, None, ""), (12, "short", ""), (13, passage(r, 50), "")]
    got = leakage.leaked(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)).collect()
    assert sorted((x.doc_id, x.item_id) for x in got) == [(1, 10), (2, 10), (3, 10), (8, 10)]


def test_blocks_give_the_same(spark, monkeypatch):
    r = random.Random(2)
    items = [(i, passage(r, 40), "") for i in range(5)]
    docs = [(i, passage(r, 30) + items[i % 5][1], "") for i in range(12)]
    a = leakage.leaked(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM))
    want = sorted(map(tuple, a.collect()))
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 400)
    b = leakage.leaked(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM))
    assert sorted(map(tuple, b.collect())) == want and len(want) == 12


def test_alignment_is_an_edit_distance():
    r = np.random.default_rng(3)
    for _ in range(200):
        a = r.integers(0, 4, 20)
        b = list(a)
        for _ in range(3):
            k = int(r.integers(0, len(b)))
            if r.random() < 0.5:
                b[k] = int(r.integers(0, 4))
            elif r.random() < 0.5:
                del b[k]
            else:
                b.insert(k, int(r.integers(0, 4)))
        b = np.array([9] * 5 + b + [9] * 5)
        best = min(_plain(a, b[i:j]) for i in range(len(b)) for j in range(i, len(b) + 1) if abs(j - i - len(a)) <= 4)
        assert leakage.edit_places([(a, b, 5), (a[:9], b, 5)], 8)[0].sum() == best


def _edited(r, text, rate):
    out = []
    for c in text:
        k = r.random()
        if k >= rate:
            out.append(c)
        elif k < rate * 0.5:
            out.append(r.choice("abcdefghijklmnopqrstuvwxyz"))
        elif k < rate * 0.75:
            out.append(c + r.choice("abcdefghijklmnopqrstuvwxyz"))
    return "".join(out)


def test_filter_loses_no_region_within_the_budget():
    r = random.Random(5)
    letters = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    for _ in range(300):
        item = letters(leakage.REGION)
        doc = list(item)
        for place in r.sample(range(1, len(doc) - 1), leakage.EDITS):
            doc[place] = r.choice(["", "0", doc[place] + "1"])
        index = leakage.Index([1], [item])
        found = leakage.leaks_of(index, pa.array([letters(50) + "".join(doc) + letters(50)]))
        assert [x[:2] for x in found] == [(0, 0)]


def test_recall_by_share_of_edits():
    r = random.Random(6)
    items = [passage(r, 70) for _ in range(60)]
    index = leakage.Index(list(range(60)), items)
    recall = {}
    for rate in (0.05, 0.1, 0.15):
        docs = pa.array([passage(r, 40) + " " + _edited(r, x, rate) + " " + passage(r, 40) for x in items])
        found = {x[:2] for x in leakage.leaks_of(index, docs)}
        assert all(a == b for a, b in found)
        recall[rate] = len(found) / 60
    print("recall", recall)
    assert recall[0.05] == 1.0 and recall[0.1] >= 0.9


def _plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_empty(spark):
    docs, items = spark.createDataFrame([], DOC), spark.createDataFrame([], ITEM)
    assert leakage.leaked(docs, items).count() == 0
    assert leakage.leaked(docs, spark.createDataFrame([(1, "x" * 300, "")], ITEM)).count() == 0
