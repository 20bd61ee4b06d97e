from loomstone.llm import mixing

DOCS = "doc_id long, text string, source string, tokens string"
MIX = "mix_id long, source string, target_share double, max_repeats long, text string"


def docs(spark):
    rows = [(i, "word " * (5 + i % 40), ["Big-One", "big_one", "small", " tiny "][min(i % 10, 3) if i % 10 < 4 else 0], "x") for i in range(600)]
    rows += [(900, None, "small", ""), (901, "", None, ""), (5, "word " * 10, "big_one", "x")]
    return spark.createDataFrame(rows, DOCS)


def mixes(spark):
    return spark.createDataFrame(
        [(1, "big_one", 0.5, 1, ""), (1, "SMALL", 0.3, 2, ""), (1, "tiny", 0.4, 3, ""), (1, "absent", 0.2, 3, ""), (2, "tiny", 1.0, 2, ""), (2, "tiny", 1.0, 2, ""), (3, "small", None, 2, ""), (4, "absent", 1.0, 1, "")],
        MIX,
    )


def test_shares_are_reached_within_caps(spark):
    rows = {(x.mix_id, x.source): x for x in mixing.shares(docs(spark), mixes(spark)).collect()}
    for source in ("big_one", "small", "tiny"):
        x = rows[1, source]
        assert abs(x.reached_share - x.wanted_share) < 0.02 and 1 <= x.repeats <= x.max_repeats
    assert abs(rows[1, "big_one"].wanted_share - 0.5 / 1.2) < 1e-5
    assert rows[1, "absent"].tokens == 0 and rows[3, "small"].tokens == 0 and rows[4, "absent"].reached_share == 0
    assert rows[2, "tiny"].reached_share == 1.0 and rows[2, "tiny"].tokens == 2 * rows[2, "tiny"].available
    used = mixing.mixture(docs(spark), mixes(spark)).collect()
    assert len({(x.mix_id, x.doc_id) for x in used}) == len(used) and all(x.tokens > 0 for x in used)


def test_curriculum_follows_the_schedule(spark):
    order = mixing.curriculum(docs(spark), mixes(spark)).where("mix_id = 1").collect()
    positions = [x.position for x in order]
    assert positions == sorted(positions) and 0 <= positions[0] and positions[-1] <= 1
    # Equal stretches of time hold about equal numbers of tokens.
    total = sum(x.tokens for x in order)
    for k in range(5):
        part = sum(x.tokens for x in order if k / 5 <= x.position < (k + 1) / 5)
        assert abs(part / total - 0.2) < 0.05


def test_documents_give_what_the_integrated_weights_ask(spark):
    rows = mixing.progress(docs(spark), mixes(spark), 4).where("mix_id = 1").collect()
    assert len(rows) == 12
    for x in rows:
        assert abs(x.asked - x.tokens) <= 2 * 60, x
    shares_ = [x.asked for x in sorted(rows, key=lambda x: x.step) if x.source == "tiny"]
    assert shares_ == sorted(shares_) or shares_ == sorted(shares_, reverse=True)


def test_offsets_are_prefix_sums(spark):
    rows = mixing.offsets(docs(spark)).collect()
    by = {}
    for x in rows:
        by.setdefault(x.source, []).append((x.offset, x.tokens))
    for own in by.values():
        at = 0
        for offset, tokens in sorted(own):
            assert offset == at
            at += tokens


def test_empty(spark):
    none = docs(spark).where("false")
    assert mixing.mixture(none, mixes(spark)).count() == 0
    assert mixing.shares(docs(spark), mixes(spark).where("false")).count() == 0
