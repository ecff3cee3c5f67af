"""Files in and out, parsers, streams."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import elements as E
from lodestrata.sources import files
from lodestrata.streaming import sessions

SCHEMA = "id int, text string"


def test_jsonl(spark, tmp_path):
    path = str(tmp_path / "a.jsonl")
    (tmp_path / "a.jsonl").write_text('{"id": 1, "text": "é"}\n\n  \n{"id": 2}\n', encoding="utf-8")
    assert [tuple(r) for r in files.read_jsonl(spark, path, SCHEMA).orderBy("id").collect()] == [(1, "é"), (2, None)]
    assert files.read_optional(spark, str(tmp_path / "none.jsonl"), SCHEMA).count() == 0 and files.read_optional(spark, path, SCHEMA).count() == 2
    (tmp_path / "b.jsonl").write_text('{"id": 1}\n{"id": x}\n{"id": 3}\n')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|[Mm]alformed"):
        files.read_jsonl(spark, str(tmp_path / "b.jsonl"), SCHEMA).collect()
    assert [r.id for r in files.read_jsonl_lenient(spark, str(tmp_path / "b.jsonl"), SCHEMA).orderBy("id").collect()] == [1, 3]
    out = str(tmp_path / "out")
    for n in (3, 2):  # the second write replaces the first
        assert files.write_jsonl(spark.range(n).withColumn("text", F.lit("ü")), out) == n
    assert files.read_jsonl(spark, out, "id long, text string").count() == 2
    assert all("ü" in line for f in (tmp_path / "out").glob("part-*") for line in f.read_text(encoding="utf-8").splitlines())


def test_json_document(spark, tmp_path):
    files.write_json(spark.sql("SELECT 1 AS a, array('x', 'é') AS b"), str(tmp_path / "j"))
    text = "".join(f.read_text(encoding="utf-8") for f in (tmp_path / "j").glob("part-*"))
    assert json.loads(text) == {"a": 1, "b": ["x", "é"]} and "é" in text and "\n  " in text
    with pytest.raises(ValueError, match="one row"):
        files.write_json(spark.range(2), str(tmp_path / "k"))


def test_metrics_and_stages(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"n": 3}')
    (tmp_path / "b.json").write_text("{broken")
    found = {r.name: (r.fields.n, r._error) for r in files.read_metrics(spark, str(tmp_path), "n int").collect()}
    assert found == {"a.json": (3, None), "b.json": (None, "{broken")}
    status = files.stage_status(files.artifacts(spark, str(tmp_path), "*.json"), [("one", "a.json"), ("one", "b.json"), ("two", "a.json"), ("two", "c.json"), ("three", "c.json")])
    assert {r.stage: (r.status, r.bytes) for r in status.collect()} == {"one": ("done", 15), "two": ("partial", 8), "three": ("pending", 0)}
    (tmp_path / "odd.txt").write_bytes(b"abc\xff\xc3\xa9 and more")
    shown = files.preview_file(spark, str(tmp_path / "odd.txt"), 6).head()
    assert shown.name == "odd.txt" and shown.text == "abc�é"
    files.clear(spark, [str(tmp_path), str(tmp_path / "new")])
    assert [p.name for p in tmp_path.iterdir()] == ["new"]


def test_parser(spark, tmp_path):
    """A parser of lines: the size before a colon, `*` for bold."""

    def spans(content):
        for i, line in enumerate(content.decode().splitlines()):
            size, text = line.split(":", 1)
            yield {"page": 1, "block": i, "line": 0, "block_type": 0, "size": float(size.strip("*")), "flags": 16 * size.startswith("*"), "text": text}

    (tmp_path / "b.txt").write_text("20:Title\n10:Some body text of the page.\n*10:Bold")
    (tmp_path / "a.txt").write_text("10:Only body")
    (tmp_path / "c.pdf").write_text("not read")
    docs = files.read_documents(spark, str(tmp_path), "*.txt")
    assert files.current_document(docs).head().name == "a.txt"
    found = E.from_spans(files.parse(docs, spans)).join(docs.select("doc_id", "name"), "doc_id").orderBy("name", "idx").collect()
    assert [(r.name, r.idx, r.type, r.text) for r in found] == [("a.txt", 0, E.TEXT, "Only body"), ("b.txt", 0, E.HEADER, "Title"), ("b.txt", 1, E.TEXT, "Some body text of the page."), ("b.txt", 2, E.HEADER, "Bold")]
    listed = files.parse(docs, lambda content: ({"type": E.TEXT, "text": t} for t in content.decode().split("\n")), files.ELEMENT)
    assert listed.groupBy("doc_id").agg(F.max("idx").alias("m")).orderBy("m").toPandas()["m"].tolist() == [0, 2]


def test_markdown(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (1, 2, None), (2, 0, "c")], "doc_id long, idx int, text string")
    assert {r.doc_id: r.markdown for r in files.documents(rows).collect()} == {1: "a\n\nb\n\n", 2: "c"}
    files.write_markdown(rows, str(tmp_path / "md"))
    assert "".join(f.read_text() for f in (tmp_path / "md" / "doc_id=1").glob("part-*")) == "a\n\nb\n\n\n"


def test_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert files.read_cache(spark, path).count() == 0
    for k in ("x", "y"):
        files.append_cache(spark.createDataFrame([("m", k, [1.0, 2.0])], "model string, key string, embedding array<float>"), path)
    assert {(r.model, r.key) for r in files.read_cache(spark, path).collect()} == {("m", "x"), ("m", "y")}


def _events(spark, rows):
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    return spark.createDataFrame([(i, at(m), u, "a", 0.0, "{}") for i, (u, m) in enumerate(rows)], sessions.EVENTS).coalesce(1)


def test_sessions_in_a_stream(spark, tmp_path):
    """Sessions whose end the watermark has passed come out as in the batch; open ones don't come at all."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    first, second = [(1, 0), (1, 5), (1, 21), (2, 3)], [(2, 300), (1, 301)]
    stream = None
    for part in (first, second):
        _events(spark, part).write.mode("append").parquet(folder)
        stream = sessions.stream_sessions(spark, folder)
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", out).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    minute = lambda t: (t - datetime.datetime(2024, 1, 1)).total_seconds() // 60
    found = sorted((r.user_id, minute(r.first_ts), minute(r.last_ts), r.n) for r in spark.read.parquet(out).collect())
    batch = sorted((r.user_id, minute(r.first_ts), minute(r.last_ts), r.n) for r in sessions.sessions(_events(spark, first + second)).collect())
    assert found == [(1, 0, 5, 2), (1, 21, 21, 1), (2, 3, 3, 1)] and found == [b for b in batch if b[2] < 250]


def test_log_tail(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("step FAILED\nwarning: x\nwrote file\nidle\n")
    query = sessions.log_tail(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("tail").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r.line, r.severity) for r in spark.table("tail").collect()} == {("step FAILED", "err"), ("warning: x", "warn"), ("wrote file", "ok"), ("idle", "info")}
