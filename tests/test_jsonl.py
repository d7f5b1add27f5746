import json
import random
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import Row

from lodestone.sources import jsonl
from lodestone.sources.jsonl import LineStreamWriter, append, append_stream, last_records, lines_from, read_lines, read_records


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50, 10_000])
def test_every_line_belongs_to_one_range(size, monkeypatch):
    r = random.Random(size)
    for text in (b"", b"\n", b"\n\n\n", b"a", b"a\n", b"a\nb", b"\n".join(bytes([97 + i % 26]) * r.randrange(9) for i in range(60))):
        monkeypatch.setattr(jsonl, "_BUFFER", r.randrange(1, 9))
        got = [x for start in range(0, len(text), size) for x in lines_from(pa.PythonFile(__import__("io").BytesIO(text), "r"), start, min(start + size, len(text)))]
        want, at = [], 0
        for line in text.split(b"\n"):
            want.append((at, line))
            at += len(line) + 1
        if not want[-1][1]:
            want.pop()
        assert got == want


def test_last_line_wins_and_a_cut_line_does_not(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    (folder / "a.jsonl").write_text('{"k": "x", "n": 9}\n{"k": "y", "n": 1}\nnot json\n[1]\n"text"\n\n{"k": "x", "n": 2}\n{"k": null, "n": 5}\n')
    (folder / "b.jsonl").write_text('{"k": "y", "n": null}\r\n{"k": "é", "n": 3}\n{"k": "x", "n"')
    (folder / "_hidden").write_text('{"k": "z", "n": 1}\n')
    for size in (5, 1 << 20):
        got = sorted(map(tuple, last_records(spark, str(folder), "k string, n long", "k", range_bytes=size).collect()))
        assert got == [("x", 2), ("y", None), ("é", 3)]
    lines = read_lines(spark, f"file://{folder}/a.jsonl", range_bytes=11).collect()
    body = (folder / "a.jsonl").read_bytes()
    assert len(lines) == 8 and all(body[r.offset :].split(b"\n")[0].decode() == r.line for r in lines)
    assert read_lines(spark, str(tmp_path / "none")).count() == 0


def rows_in(spark, path):
    return sorted(r.n for r in read_records(spark, path, "n long", committed=True).collect())


def test_a_replayed_batch_counts_once(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [Row(n=i) for i in range(3)]
    w = LineStreamWriter({"path": path, "writer": "a"})
    w.commit([w.write(iter(rows)), w.write(iter([]))], 0)
    again = LineStreamWriter({"path": path, "writer": "a"})
    again.commit([again.write(iter(rows))], 0)
    lost = again.write(iter([Row(n=99)]))  # a task that was tried and never committed
    assert rows_in(spark, path) == [0, 1, 2]
    again.abort([lost, None], 1)
    other = LineStreamWriter({"path": path, "writer": "b"})  # a second writer has its own batches
    other.commit([other.write(iter([Row(n=7)]))], 0)
    assert rows_in(spark, path) == [0, 1, 2, 7]
    assert len(list(Path(path).glob("part-*"))) == 2


def test_streams_of_two_writers_and_a_restart(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(20).selectExpr("id n").repartition(4).write.parquet(source)
    stream = lambda: spark.readStream.schema("n long").option("maxFilesPerTrigger", 1).parquet(source)
    for writer, checkpoint in (("a", "c1"), ("b", "c2"), ("a", "c1")):
        append_stream(stream(), path, str(tmp_path / checkpoint), writer).awaitTermination()
    assert rows_in(spark, path) == sorted([*range(20)] * 2)
    append_stream(stream(), path, str(tmp_path / "lost"), "a").awaitTermination()  # its checkpoint is gone: all batches replayed
    assert rows_in(spark, path) == sorted([*range(20)] * 2)


def test_a_run_is_appended_once(spark, tmp_path):
    path = str(tmp_path / "run")
    frame = spark.createDataFrame([(1, "é", [1, 2])], "n long, t string, xs array<long>")
    for _ in range(2):
        append(frame, path, "r1")
    append(frame.selectExpr("n + 1 n", "t", "xs"), path, "r2")
    found = [json.loads(r.line) for r in read_lines(spark, path, committed=True).collect()]
    assert sorted(found, key=lambda x: x["n"]) == [{"n": 1, "t": "é", "xs": [1, 2]}, {"n": 2, "t": "é", "xs": [1, 2]}]
    with pytest.raises(Exception, match="only appended"):
        frame.write.format(jsonl.FORMAT).mode("overwrite").save(path)
