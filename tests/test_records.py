import json
import random

import pytest
from oracle import SF, expected, rows
from pyspark.sql import functions as F

from quarryline.functions import records as FR
from quarryline.operators import events as E
from quarryline.plans import queries as Q
from quarryline.sources import records as R
from quarryline.streaming import sessions as SS


def plain(text: bytes) -> list[tuple]:
    """(event, data) of a whole file, line by line."""
    out, event, data = [], None, []
    for line in [*text.decode("utf-8", "replace").split("\n"), ""]:
        line = line.strip()
        if not line:
            out += [(event, "\n".join(data))] if event and data else []
            event, data = None, []
        elif line.startswith("event:"):
            event = line[6:].strip()
        elif line.startswith("data:"):
            data.append(line[5:].strip())
    return out


def drawn(seed: int, n: int = 60) -> bytes:
    r = random.Random(seed)
    lines = ["event: a", "event:b", "data: 1", "data:{\"x\": 2}", "data: ü€", "", "", "", " \t", ": note", "id: 4", "event:", "data:", "x" * 40]
    return "".join(r.choice(lines) + r.choice(["\n", "\n", "\r\n"]) for _ in range(n)).encode()[: -r.choice([0, 1, 3]) or None]


def batches(files, ranges):
    return [x for r in ranges for b in files.rows(r) for x in b.to_pylist()]


@pytest.mark.parametrize("split", [1, 2, 7, 64, 1 << 20])
def test_ranges_hold_each_record_once(tmp_path, split, monkeypatch):
    monkeypatch.setattr(R, "TAIL", 5)
    for seed in range(25):
        (tmp_path / "job").write_bytes(text := drawn(seed))
        files = R._Files({"path": str(tmp_path), "split": str(split)})
        got = batches(files, files.ranges("job", 0, len(text)))
        assert [(x["event"], x["data"]) for x in got] == plain(text)
        assert [x["position"] for x in got] == sorted({x["position"] for x in got})
        assert all(text[x["position"] :].lstrip(b" \t").startswith((b"event:", b"data:")) for x in got)


@pytest.mark.parametrize("mode", ["sse", "data", "lines"])
def test_growing_files_lose_and_repeat_nothing(tmp_path, mode):
    r = random.Random(3)
    for seed in range(25):
        text, got, start, at = drawn(seed), [], {}, 0
        options = {"path": str(tmp_path / str(seed)), "mode": mode, "split": "16"}
        (tmp_path / str(seed)).mkdir()
        while at < len(text):
            at = min(len(text), at + r.randint(1, 90))
            (tmp_path / str(seed) / "job").write_bytes(text[:at])
            if at == len(text):
                (tmp_path / str(seed) / "job.end").touch()
            reader = R._Stream(options)  # as after a restart
            end = reader.latestOffset()
            got += batches(reader.files, reader.partitions(start, end))
            start = end
        assert start == {"job": len(text)}
        want = {"sse": plain(text), "lines": [(None, x.strip()) for x in text.decode("utf-8", "replace").split("\n") if x.strip()], "data": [(None, x.strip()[6:]) for x in text.decode("utf-8", "replace").split("\n") if x.strip().startswith("data: ")]}
        assert [(x["event"], x["data"]) for x in got] == want[mode]


def test_heads_of_responses():
    body = b"\r\n\r\nevent: a\ndata: 1\n\n"
    assert [x[1:] for x in R.parse(b"HTTP/1.1 200 OK\r\nX: y" + body, 0, "sse")] == [("a", "1")]
    assert [json.loads(x[2]) for x in R.parse(b"HTTP/1.1 401 No" + body, 0, "sse")] == [{"message": "Authentication failed"}]
    assert [json.loads(x[2]) for x in R.parse(b"HTTP/2 503 Busy\r\nX: y\r\n\r\ntry \xff later", 0, "data")] == [{"message": "Request failed: 503 - try � later"}]
    assert list(R.parse(b"", 0, "sse")) == [] and [x[1:] for x in R.parse(b"HTTP/1.1 500 x", 9, "lines")] == [(None, "HTTP/1.1 500 x")]


def test_odd_folders(spark, tmp_path):
    R.register(spark)
    read = lambda p, **o: spark.read.format("records").options(**o).load(str(p))
    assert read(tmp_path).collect() == [] and read(tmp_path / "none").collect() == []
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "empty").touch()
    (tmp_path / "a" / "_SUCCESS").write_bytes(b"event: a\ndata: 1\n")
    (tmp_path / "a" / "one").write_bytes(b"event: a\ndata: " + b"z" * 300_000)
    assert [(r.job, r.position, r.event, len(r.data)) for r in read(tmp_path, split=1000).collect()] == [("a/one", 0, "a", 300_000)]
    with pytest.raises(Exception, match="mode is sse"):
        read(tmp_path, mode="x").collect()


def test_types_and_messages(spark):
    df = spark.createDataFrame([("a", '{"x": 1}'), ("b", "plain \"q\""), (None, "[1]"), ("a", "null"), ("a", "")], "event string, data string")
    got = [(r.r.type, json.loads(r.r.data)) for r in df.select(FR.typed(F.col("event"), F.col("data"), ["a"]).alias("r")).collect()]
    assert got == [("a", {"x": 1}), ("error", {"message": 'plain "q"'}), ("error", [1]), ("a", None), ("a", {"message": ""})]


def test_stream_goes_on_after_a_restart_and_ends(spark, tmp_path):
    R.register(spark)
    folder, got = tmp_path / "in", []
    folder.mkdir()
    steps = [
        {"p": b"event: go\ndata: 1\n\nevent: go\nda", "q": b"event: go\ndata: 1\n\n"},
        {"p": b"ta: 2\n\nevent: complete\ndata: 3\n\nevent: go\ndata: 4\n\n", "q.end": b""},
        {"p": b"event: go\ndata: 5\n\n", "r": b"event: go\ndata: 6", "r.end": b""},
        {"s": b"event: go\ndata: 7\n\n"},
    ]
    for step in steps:
        for name, more in step.items():
            with open(folder / name, "ab") as f:
                f.write(more)
        stream = spark.readStream.format("records").option("archive", str(tmp_path / "done")).load(str(folder)).withColumnRenamed("event", "type")
        q = SS.until_terminal(stream, ["complete", "error"]).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "check"))
        q = q.foreachBatch(lambda df, _: got.extend(map(tuple, df.select("job", "type", "data").collect()))).trigger(availableNow=True).start()
        q.awaitTermination()
    want = [("p", "complete", "3"), ("p", "go", "1"), ("p", "go", "2"), ("q", "go", "1"), ("r", "go", "6"), ("s", "go", "7")]
    assert sorted(got) == want
    assert sorted(x.name for x in (tmp_path / "done").iterdir())[:1] == ["q"] and not (folder / "q").exists()
    whole = spark.read.format("records").load(str(folder)).withColumnRenamed("event", "type")
    batch = E.until_terminal(whole.where("job = 'p'"), "job", ["position"], F.col("type") == "complete")
    assert sorted(map(tuple, batch.select("job", "type", "data").collect())) == want[:3]


def test_query_equals_sql(spark):
    cols, got = rows(Q.QUERIES["event_source"](spark, SF))
    assert got == expected(Q.SQL["event_source"], cols) and len(got) > 0
