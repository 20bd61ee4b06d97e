import itertools
import os
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from loomstone.llm import labelled, personal

SCHEMA = (
    "payload_id long, prompt string, tool_input struct<description:string,prompt:string,subagent_type:string,command:string,path:string,text:string>, field string, kind string"
)


def test_held_out_accuracy():
    tagger = personal.trained()
    rows = labelled.sentences(250, seed=1234)
    right = wanted = extra = 0
    for (text, items), got in zip(rows, personal.tag(tagger, [t for t, _ in rows])):
        a, b = {(k, s) for s, _, k in items}, {(k, s) for s, _, k in got}
        right, wanted, extra = right + len(a & b), wanted + len(a), extra + len(b - a)
    assert right / wanted > 0.97 and extra / wanted < 0.02


def test_sentences_unlike_the_labelled_ones():
    said = [
        ("I spoke with Marek Jovanovic at noon and he was glad.", ["name"]),
        ("Her line is 020 7946 0311 but try r.keller@post.example.com first.", ["phone", "email"]),
        ("Deliveries for Dr Hollis go to 14 Marlow Road, Westham.", ["name", "address"]),
        ("The kettle in Room 12 boils over at 10:30.", []),
        ("Upgrade to release 4.12.7 and reboot 192.0.2.14.", []),
    ]
    for (text, kinds), got in zip(said, personal.tag(personal.trained(), [t for t, _ in said])):
        assert [k for *_, k in got] == kinds, (text, got)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_labelled_sentences_are_not_the_test_tables_own():
    rows = pq.read_table("/root/testdata/sf0.001/hook_payloads.parquet", columns=["prompt", "tool_input"]).to_pylist()
    texts = "\n".join({x for r in rows for x in (r["prompt"], (r["tool_input"] or {}).get("prompt"), (r["tool_input"] or {}).get("command")) if x})
    for template in labelled.TEMPLATES:
        for part in re.split(r"\{\w+\}", template.replace("{{", "{").replace("}}", "}")):
            assert not any(part[k : k + 14] in texts for k in range(len(part) - 13)), template
    people = pq.read_table("/root/testdata/sf0.001/person_entities.parquet", columns=["first_name"])["first_name"].to_pylist()
    assert not {x.lower() for x in people if x} & set(labelled.GIVEN)


def test_viterbi_finds_the_best_path():
    r = np.random.default_rng(1)
    t = personal.Tagger()
    n = len(personal.LABELS)
    t.moves = r.normal(size=(n, n))
    emit = r.normal(size=(3, n))
    starts = [i for i, x in enumerate(personal.LABELS) if x[0] != "I"]
    best = max(
        (p for p in itertools.product(range(n), repeat=3) if p[0] in starts),
        key=lambda p: sum(emit[i, y] for i, y in enumerate(p)) + t.moves[p[0], p[1]] + t.moves[p[1], p[2]],
    )
    assert tuple(t.decode([emit, emit[:1]])[0]) == best


def test_fitting_raises_the_likelihood_and_batches_agree():
    data = labelled.sentences(40, 5)
    t = personal.Tagger().fit(data, epochs=30)
    right = [[(s, e, k) for s, e, k in items] == got for (_, items), got in zip(data, personal.tag(t, [x for x, _ in data]))]
    assert np.mean(right) > 0.8
    assert [personal.tag(t, [x])[0] for x, _ in data] == personal.tag(t, [x for x, _ in data])


def test_an_item_in_a_long_line_is_one_item():
    text = "filler words here and more of them, " * 300 + "mail to r.keller@post.example.com or dial (212) 555-0134 now"
    got = personal.tag(personal.trained(), [text])[0]
    assert [(text[a:b], k) for a, b, k in got] == [("r.keller@post.example.com", "email"), ("(212) 555-0134", "phone")]


def test_query(spark):
    note = "Look up Ingrid Halverson in the Norwick roster and mail the summary to i.halverson@mail.norwick.example.org."
    rows = [
        (1, note, None, "c", "c"),
        (1, note, None, "c", "c"),
        (2, None, ("d", "text (212) 555-0134 as soon as the ledger is ready", None, None, None, None), "c", "c"),
        (3, None, (None, None, None, "git clone git@forge.Norwick.test:teams/Norwick.git", None, None), "c", "c"),
        (4, "", None, None, None),
        (5, " \n ", (None, None, None, None, None, None), "", ""),
        (6, "filler words here. " * 3000 + note, None, "", ""),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, personal.found(df).collect()))
    assert got == sorted(
        [(p, "prompt", k, 1) for p in (1, 6) for k in ("name", "email")] + [(2, "tool_input.prompt", "phone", 1)]
    )
    text = {(x.payload_id, x.field): x.redacted for x in personal.tagged(df).collect()}
    assert text[1, "prompt"] == "Look up [NAME] in the Norwick roster and mail the summary to [EMAIL]."
    assert text[3, "tool_input.command"] == rows[3][2][3] and text[4, "prompt"] == ""
    assert personal.found(df.where("false")).count() == 0
