import random

from pyspark.sql import functions as F

from loomstone.operators import history as h

SCHEMA = "triple_id long, subject string, predicate string, object string, valid_from string, valid_to string, source_ref string, recorded_at timestamp, _key string"


def ts(n):
    import datetime as dt

    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)


def iso(n):
    return ts(n).strftime("%Y-%m-%dT%H:%M:%SZ")


def brute(rows):
    slots = {}
    for tid, s, p, o, vf, vt, _, rec, _k in rows:
        start = int(vf) if vf is not None else rec
        if start is None or (vt is not None and vt <= start):
            continue
        best = slots.setdefault((s, p), {}).get(start)
        if best is None or (rec, tid) > best[0]:
            slots[(s, p)][start] = ((rec, tid), o, vt)
    out = []
    for (s, p), own in slots.items():
        versions = []
        for start in sorted(own):
            _, o, vt = own[start]
            if versions and versions[-1][1] == o and not (versions[-1][2] is not None and versions[-1][2] < start):
                versions[-1][2] = vt
            else:
                versions.append([start, o, vt])
        for i, (start, o, vt) in enumerate(versions):
            ends = [x for x in (vt, versions[i + 1][0] if i + 1 < len(versions) else None) if x is not None]
            out.append((s, p, iso(start), iso(min(ends)) if ends else "", o))
    return sorted(out, key=str)


def load(spark, rows):
    data = [(t, s, p, o, iso(vf) if vf is not None else None, iso(vt) if vt is not None else None, c, ts(r), k) for t, s, p, o, vf, vt, c, r, k in rows]
    return spark.createDataFrame(data, SCHEMA)


def make(seed, n, keys, span):
    r = random.Random(seed)
    return [
        (i, r.choice(keys), r.choice(["p", None]), r.choice(["a", "b", None]), r.choice([None, *range(span)]), r.choice([None, None, *range(span + 5)]), "x", r.randrange(span), "clash")
        for i in range(n)
    ]


def test_versions_match_brute_force(spark):
    rows = make(1, 400, ["s", "s", "t", "u", None], 60)
    got = sorted((tuple(x) for x in h.attribute_history(load(spark, rows)).collect()), key=str)
    assert got == brute(rows)


def test_one_hot_history_over_many_chunks(spark):
    rows = make(2, 900, ["s"], 3000)
    got = sorted((tuple(x) for x in h.attribute_history(load(spark, rows)).collect()), key=str)
    assert got == brute(rows)


def test_ledger_knows_what_was_believed_at_any_time(spark):
    rows = make(3, 300, ["s", "t"], 200)
    ledger = h.bitemporal_ledger(load(spark, rows)).collect()
    base = 1704067200
    for at in (20, 77, 150, 199):
        micros = (base + at * 3600) * 1_000_000
        held = [x for x in ledger if x.recorded_from <= micros and (x.recorded_to is None or x.recorded_to > micros)]
        known = {}
        for tid, s, p, o, vf, vt, _, rec, _k in rows:
            start = vf if vf is not None else rec
            if rec <= at and not (vt is not None and vt <= start):
                old = known.setdefault((s, p), {}).get(start)
                known[(s, p)][start] = max(old or (-1, -1, None), (rec, tid, o), key=lambda x: x[:2])
        want = set()
        for key, own in known.items():
            starts = sorted(own)
            for a, b in zip(starts, [*starts[1:], None]):
                want.add((key, a, b, own[a][2]))
        hours = lambda m: None if m is None else (m // 1_000_000 - base) // 3600
        assert {((x.subject, x.predicate), hours(x.valid_from), hours(x.next_from), x.value) for x in held} == want


def test_reports_in_order_leave_nothing_open(spark):
    n = 1_000_000
    ids = spark.range(n)
    slots = ids.select(F.lit("k").alias("_key"), F.col("id").alias("_start"), F.when(F.col("id") % 9973 == 0, F.col("id") - 50).otherwise(F.col("id")).alias("_at"))
    ranged = slots.repartitionByRange(8, "_key", "_start").sortWithinPartitions("_key", "_start").select(F.spark_partition_id().alias("_chunk"), "*")
    swept = ranged.mapInPandas(h._sweep, h._SWEPT)
    asked, minima = h.open_rows(swept)
    assert minima.count() == 8 and asked.count() < n / 100


def test_chunk_edges_match_brute_force(spark):
    r = random.Random(8)
    for kind in (lambda i: i, lambda i: 500 - i, lambda i: r.randrange(40), lambda i: i if i % 50 else 3):
        rows = [("k" if i < 450 else f"z{i}", i, kind(i)) for i in range(500)]
        got = {(x._start, x._at): x._end for x in h._interval_ends(spark.createDataFrame(rows, "_key string, _start long, _at long")).collect()}
        want = {}
        for key, start, at in rows:
            own = [(s, a) for k, s, a in rows if k == key]
            for moment in {a for _, a in own if a >= at}:
                nxt = [s for s, a in own if s > start and a <= moment]
                old = [s for s, a in own if s > start and a < moment]
                if nxt and (moment == at or not old or min(nxt) != min(old)):
                    want[start, moment] = min(nxt)
        assert got == want


def test_empty_and_unreadable(spark):
    assert h.attribute_history(load(spark, [])).count() == 0
    odd = spark.createDataFrame([(1, "s", "p", "o", "soon", " ", None, ts(3), "k"), (2, "s", "p", "o", None, None, None, None, "k")], SCHEMA)
    assert [tuple(x) for x in h.attribute_history(odd).collect()] == [("s", "p", iso(3), "", "o")]


def test_instants(spark):
    from pyspark.sql import functions as F

    from loomstone.functions.instants import iso_utc, parse_instant

    forms = ["2024-10-11T03:50:59+09:00", "2024-10-10 18:50:59Z", "20241010T185059Z", "2024-10-10T18:50:59.7Z", "2024-10-10T13:50:59-0500", "2024-10-11T03:50:59+09", " 2024-10-10t18:50:59z "]
    df = spark.createDataFrame([(x,) for x in [*forms, "2024-10-10", "2024-10-10T18:50Z", "2024-13-10", "x"]], "x string")
    got = [r[0] for r in df.select(iso_utc(parse_instant(F.col("x")))).collect()]
    assert got[:7] == ["2024-10-10T18:50:59Z"] * 7
    assert got[7:] == ["2024-10-10T00:00:00Z", "2024-10-10T18:50:00Z", None, None]
