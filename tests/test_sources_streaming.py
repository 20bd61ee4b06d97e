import datetime as dt
import json

import pytest

from loomstone.operators.trace import seal_event
from loomstone.sources import documents, tail
from loomstone.streaming import chains


def chain(run, n, tamper=None):
    out, last = [], None
    for i in range(n):
        event = seal_event({"type": "note", "run_id": run, "event_id": str(i), "value": i / 3}, last)
        last = event["hash"]
        if i == tamper:
            event = event | {"value": 99}
        out.append(json.dumps(event, sort_keys=True, separators=(",", ":")))
    return out


def test_documents(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\nök\n")
    (tmp_path / "b.bin").write_bytes(b"x")
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe bad")
    rows = documents.document_ids(documents.load_documents(spark, str(tmp_path))).collect()
    assert [r.text for r in rows] == ["# A\nök\n"] and rows[0].doc_id.startswith("doc_")


def test_trace_file_without_its_torn_line(spark, tmp_path):
    f = tmp_path / "t.jsonl"
    lines = chain("r", 3)
    f.write_text("\n".join(lines) + "\nnot json\n" + '{"torn": ')
    got = documents.read_trace(spark, str(f)).orderBy("seq").collect()
    assert [r.raw for r in got] == lines


def test_tail_and_stateful_verifier_resume(spark, tmp_path):
    tail.register(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    f = tmp_path / "t.jsonl"
    lines = chain("r", 6, tamper=4)
    results = []

    def run():
        stream = spark.readStream.format("jsonl_tail").load(str(f))
        q = (
            chains.verify_stream(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp"))
            .foreachBatch(lambda df, _: results.extend(tuple(r)[:3] for r in df.collect())).trigger(availableNow=True).start()
        )
        q.awaitTermination(120)

    f.write_text("\n".join(lines[:3]) + "\n" + lines[3][:10])
    run()
    f.write_text("\n".join(lines) + "\n")
    run()
    assert results == [("r", 3, True), ("r", 6, False)]


def test_call_pairing_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(1, "PreToolUse", 0), (2, "PreToolUse", 5), (3, "PostToolUse", 9), (4, "PostToolUse", 20), (5, "PreToolUse", 30), (6, "PostToolUse", 2000)]
    data = [(i, e, "s", None, "bash", at(s)) for i, e, s in rows]
    spark.createDataFrame(data, "payload_id long, hook_event_name string, session_id string, agent_id string, tool_name string, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    got = []
    q = chains.pair_stream(stream).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, _: got.extend(map(tuple, df.collect()))).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(got) == [(1, 3, 9), (2, 4, 15)]


@pytest.mark.parametrize("width,n", [("1 hour", 2)])
def test_windows(spark, tmp_path, width, n):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    spark.createDataFrame([(at(5), "a", 1.0), (at(50), "a", 2.0), (at(70), "a", 3.0)], "ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "e"))
    got = []
    q = chains.windowed_counts(stream, width=width).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, _: got.extend(df.collect())).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.w.start.hour, r.events) for r in got} == {(0, 2), (1, 1)}
