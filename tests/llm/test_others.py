"""WARC, chat, and the pipeline."""

from __future__ import annotations

import gzip

import corpus_pipeline
import pyarrow as pa
from pyspark.sql import functions as F

from rentlens.llm import chat, warc
from rentlens.llm.common import scratch, stored


def test_warc_round_trip(spark):
    big = "<html>" + "x" * 200
    rows = [(3, "http://a/1", big, 1), (1, None, big, 2), (2, "http://a/2\r\nX: y", big, 3), (4, "u", "small", 4), (5, "u", "small", 5), (6, "u", None, 6), (None, "u", "é" * 100, 7), (1, None, big, 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload long")
    path = scratch(spark, "warc")
    found = warc.archived(pages, path).collect()
    assert len(found) == len(rows)
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to or 0, r.payload_bytes) for r in found)
    assert kinds == [(0, "response", 0, 200), (1, "response", 0, 206), (1, "response", 0, 206), (2, "revisit", 1, 206), (3, "revisit", 1, 206), (4, "response", 0, 5), (5, "response", 0, 5), (6, "response", 0, 0)]
    assert warc.read(spark, path, ["record_id"], record_type=["revisit"]).count() == 2
    assert warc.read(spark, path, ["uri"], uri_prefix="http://a/").count() == 2
    assert warc.archived(pages.limit(0), scratch(spark, "warc")).count() == 0


def test_warc_of_other_writers(spark, tmp_path):
    record = warc.record({"record_id": "1", "record_type": "response", "uri": "u", "refers_to": None, "payload_digest": "d", "payload_bytes": 3, "payload": b"abc"})
    (tmp_path / "a.warc").write_bytes(record * 3)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record) * 2)
    warc.register(spark)
    assert [bytes(r.payload) for r in warc.read(spark, str(tmp_path), ["payload"]).collect()] == [b"abc"] * 5


def warc_record(name: str, payload: bytes, uri: str = "u") -> bytes:
    return warc.record({"record_id": name, "record_type": "response", "uri": uri, "refers_to": None, "payload_digest": "d", "payload_bytes": len(payload), "payload": payload})


def test_warc_in_one_member_with_long_headers_and_payloads(spark, tmp_path):
    """Plain, in one gzip member, in several, and mixed; a header of 100 KB and a payload of 3 MB between short records."""
    payloads = {"a": b"abc", "b": bytes(range(256)) * 12_000, "c": b"", "d": b"x\r\n\r\ny"}
    uris = {"a": "u", "b": "data:" + "u" * 100_000, "c": "v" * 20_000, "d": "u"}
    every = [warc_record(k, payloads[k], uris[k]) for k in payloads]
    files = {"1.warc": b"".join(every), "2.warc.gz": gzip.compress(b"".join(every)), "3.warc.gz": b"".join(map(gzip.compress, every)), "4.warc.gz": b"".join(map(warc.member, every))}
    files["5.warc.gz"] = gzip.compress(b"".join(every[:2])) + warc.member(every[2]) + gzip.compress(every[3])
    warc.register(spark)
    for name, data in files.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / name).write_bytes(data)
        found = warc.read(spark, str(tmp_path / name)).collect()
        assert {r.record_id: bytes(r.payload) for r in found} == payloads and len(found) == 4, name
        assert {r.record_id: r.uri for r in found} == uris, name
        heads = warc.read(spark, str(tmp_path / name), ["record_id", "payload_bytes"], record_id=["b", "d"]).collect()
        assert {r.record_id: r.payload_bytes for r in heads} == {k: len(payloads[k]) for k in "bd"}, name


def test_warc_jobs_add_records(spark):
    pages = spark.createDataFrame([(k, f"http://a/{k}", f"<html>{k}") for k in range(5)], "page_id long, url string, html string")
    path = scratch(spark, "warc")
    warc.register(spark)
    for first, end in ((0, 2), (2, 2), (2, 5)):
        warc.archive(warc.page_records(pages.where(F.col("page_id").between(first, end - 1))), path)
    assert sorted(int(r.record_id) for r in warc.read(spark, path, ["record_id"]).collect()) == list(range(5))


def test_warc_abort_leaves_no_file(tmp_path):
    writer, other = warc.WarcWriter(str(tmp_path)), warc.WarcWriter(str(tmp_path))
    row = {"record_id": "1", "record_type": "response", "uri": "u", "refers_to": None, "payload_digest": "d", "payload_bytes": 1, "payload": b"x"}
    batch = pa.RecordBatch.from_pylist([row])
    other.commit([other.write(iter([batch]))])
    writer.write(iter([batch]))
    writer.abort([None])
    assert len(list(tmp_path.glob("*.warc.gz"))) == 1 and not list(tmp_path.glob(f"{writer.job}*"))


def test_common_pages_are_not_dealt_by_digest(spark, monkeypatch):
    """A payload of most rows goes by broadcast, small ones are never joined; the result is the same."""
    rows = [(k, "u", "<html>" + "y" * 200) for k in range(60)] + [(100 + k, "u", f"{k % 3}" * 150) for k in range(9)] + [(200 + k, "u", "") for k in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    key = lambda r: (r.record_id, r.record_type, r.refers_to)
    found = []
    for heavy in (1, 1000):
        monkeypatch.setattr(warc, "HEAVY", heavy)
        found.append(sorted(map(key, warc.page_records(pages).collect()), key=str))
    assert found[0] == found[1] and sum(x[1] == "revisit" for x in found[0]) == 59 + 6
    assert {x[2] for x in found[0]} == {None, "0", "100", "101", "102"}


def test_trees_give_every_path(spark):
    """Two equal branches by score, a branch without, and a root whose parent does not exist."""
    schema = "tree string, node long, parent long, role string, text string, score double, head string, leaf long, turns string"
    nodes = [("t", 1, None, "user", "q", 1.0), ("t", 2, 1, "assistant", "a", 5.0), ("t", 3, 1, "assistant", "b", 9.0), ("t", 4, 3, "user", None, 0.0), ("t", 5, 1, "assistant", "a", 5.0), ("u", 1, 77, "user", "root", None)]
    found = chat.conversations(spark.createDataFrame([(*n, "h", 7, "x") for n in nodes], schema))
    rows = {(r.tree, r.leaf): (r.branch_rank, r.n_turns, r.score, r.formatted) for r in found.collect()}
    assert rows == {
        ("t", 4): (1, 3, 10 / 3, "### user: q</turn>\n### assistant: b</turn>\n### user: </turn>\n"),
        ("t", 2): (2, 2, 3.0, "### user: q</turn>\n### assistant: a</turn>\n"),
        ("t", 5): (3, 2, 3.0, "### user: q</turn>\n### assistant: a</turn>\n"),
        ("u", 1): (1, 1, None, "### user: root</turn>\n"),
    }
    best = chat.conversations(spark.createDataFrame([(*n, "h", 7, "x") for n in nodes], schema), top=1)
    assert {(r.tree, r.leaf) for r in best.collect()} == {("t", 4), ("u", 1)}


def test_long_paths_by_plans_that_do_not_grow(spark):
    """One conversation of 300 equal and very long turns: nine levels, each a single join."""
    rows = spark.createDataFrame([(5, 1, "assistant", "x" * 3000)] * 300, "conv_id long, turn long, role string, text string")
    nodes = chat.as_trees(rows)
    folder = scratch(spark, "chat")
    nodes = stored(nodes, f"{folder}/nodes")
    tables = chat.steps(nodes, folder)
    way = chat.paths(nodes, tables, folder)
    assert len(tables) == 9 and "Join" not in way._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.back for r in way.collect()) == list(range(300))
    only = chat.digests(stored(chat.conversations(chat.as_trees(rows)), scratch(spark, "chat"))).collect()
    assert [(r.n_turns, r.loss_chars) for r in only] == [(300, 900_000)]


def test_spans_lie_where_the_texts_are(spark):
    rows = spark.createDataFrame([(1, 0, "user", "é### \\"), (1, 1, "assistant", "日本 </turn>"), (1, 2, "assistant", "")], "conv_id long, turn long, role string, text string")
    r = chat.conversations(chat.as_trees(rows)).first()
    assert [(r.formatted[s.start : s.start + s.length], s.loss) for s in r.spans] == [("é\\h\\\\", False), ("日本 \\t", True), ("", True)]


def test_texts_come_back(spark):
    nasty = ["", "\\", "\\h", "### user: x</turn>\n", "a</turn", "\\\\t", "</turn>###  ### \\", None]
    rows = [(7, k, "assistant" if k % 2 else "us:er", t) for k, t in enumerate(nasty)] + [(None, 0, None, None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    output = stored(chat.conversations(chat.as_trees(frame)), scratch(spark, "chat"))
    parsed = {r.tree: r.turns for r in chat.parsed(output).collect()}
    assert [t.text for t in parsed["7"]] == [x or "" for x in nasty] and parsed["7"][0].role == "us:er"
    assert [t.masked for t in parsed["7"]] == [(x or "") if k % 2 else None for k, x in enumerate(nasty)]
    assert chat.digests(output).count() == 2
    assert chat.conversations(chat.as_trees(frame.limit(0))).count() == 0


def test_pipeline_keeps_columns_and_ends_in_tokens(spark, docs):
    rows = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stored(stage(spark, rows, "/root/testdata/sf0.001"), scratch(spark, "stage"))
        assert rows.columns == docs.columns
    last = corpus_pipeline.STAGES[-1][1](spark, rows, "/root/testdata/sf0.001")
    assert last.count() == rows.count()
