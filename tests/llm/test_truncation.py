import random

import pytest

from loomstone.llm import truncation as t

SCHEMA = "doc_id long, text string, source string, measure string, length int"


@pytest.mark.parametrize(
    "text,verdict",
    [
        ("All is well. The end.", "whole"),
        ("He said: \"enough.\"", "whole"),
        ("A start. And then the ledg", "cut"),
        ("A start. And then the ledger [cut]", "cut"),
        ("A start. And then the le...<640 chars>", "cut"),
        ("A start. It is said", "cut"),
        ("A start. It ends. �", "cut"),
        ("A start.\n\nEND OF NOTE", "whole"),
        ("A start.\n\n- one thing\n- another", "whole"),
        ("1. We met here.\n2. We left agai", "cut"),
        ("A start.\n\nTags: a, b", "whole"),
        ("A start.\n\nBest regards\nSome Desk", "whole"),
        ("A start.\n\n— the planner, at noon", "whole"),
        ("A start.\n\n```\nrun --now\n```", "whole"),
        ("A start.\n\nscope: x\nstatus: done", "whole"),
        ("A start. See /notes/x/y.md", "whole"),
        ("A start. And so it waits...", "soft"),
    ],
)
def test_endings(text, verdict):
    assert t.inspect(text)[0] == verdict


def corpus():
    r = random.Random(3)
    rows, cut = [], set()
    for i in range(300):
        text = " ".join(f"The {r.choice(['clerk', 'porter', 'warden'])} moved {r.randrange(10**6)} {r.choice(['café', 'cafe', 'tea'])} files to room {r.randrange(99)} today." for _ in range(6))
        if i % 3 == 0:
            text = text.encode()[:200].decode("utf-8", "ignore")
            if text.rstrip().endswith("."):
                text = text.rstrip()[:-2]
            cut.add(i)
        rows.append((i, text, "Feed-A" if i % 2 else "feed_a", "m", 1))
    rows += [(900, None, "feed_a", "", 0), (901, " ", None, "", 0), (902, "", "x", "", 0)]
    return rows, cut


def test_corpus_and_limit(spark):
    rows, cut = corpus()
    df = spark.createDataFrame(rows + rows[:5], SCHEMA)
    found = t.truncated(df).collect()
    assert {x.doc_id for x in found} == cut and len(found) == len(cut)
    rate = {x.source: x for x in t.truncation_rates(df).collect()}
    assert rate["feed_a"].cut == len(cut)
    limits = t.hidden_limits(t.measured_texts(df)).collect()
    assert any(x.measure == "utf8" and x.length in (198, 199, 200) for x in limits), limits


def test_a_known_limit_tells_without_the_endings(spark):
    r = random.Random(5)
    text = lambda: " ".join(f"The clerk moved {r.randrange(10**6)} files to the {'r' * r.randrange(40)}oom today." for _ in range(r.randrange(7, 30)))
    rows = [(i, text()[:300] if i % 4 == 0 else text(), "feed", "m", 1) for i in range(400)]
    rows += [(1000 + i, text() + f" [{'truncated: ' + 'x' * 500}]", "mail", "m", 1) for i in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    named = {x.doc_id for x in t.judged(df, endings=False).collect()}
    assert {i for i, x, *_ in rows[:400] if i % 4 == 0 and len(x) == 300} <= named and len(named) <= 105
    found = {x.doc_id for x in t.truncated(df).collect()}
    assert found <= named and len(found) >= 0.9 * len(named)


def test_marks_of_any_length_and_long_texts():
    assert t.inspect("A start. And then the ledg [truncated " + "y" * 900 + "]")[0] == "cut"
    assert t.inspect("A start. And then the ledg (an aside)")[0] == "cut"
    assert t.inspect("w " * 200_000 + "It ends.")[0] == "whole"
    assert t.lengths(t.pa.array(['é<"\r\n𝒳'])).tolist() == [[6, 10, 7, 14, 9, 6, 10, 14, 5, 9, 13]]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert t.truncated(df).count() == 0 and t.truncation_rates(df).count() == 0


def test_copies_of_one_text_make_no_phrase(spark):
    own = [(i, f"Note {i} says the clerk moved {i * 37} files. But who can really say...", "a", "m", 1) for i in range(6)]
    copies = [(100 + i, "The porter came in. He then moved the heavy led...", "b", "m", 1) for i in range(8)]
    found = {x.doc_id for x in t.truncated(spark.createDataFrame(own + copies, SCHEMA)).collect()}
    assert found == {i for i, *_ in copies}
