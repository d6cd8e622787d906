import json

from pyspark.sql import functions as F

from provmill.sources import logs
from provmill.streaming import growing, tail
from test_logs import entry


def drain(spark, stream, tmp_path, name):
    """One run of the stream, from where its checkpoint says."""
    q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"c-{name}")).option("path", str(tmp_path / f"o-{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None
    return spark.read.schema(stream.schema).parquet(str(tmp_path / f"o-{name}"))


def test_a_log_that_grows_between_runs(spark, tmp_path):
    d = tmp_path / "proj"
    d.mkdir()
    log, glob = d / "a.jsonl", str(tmp_path / "proj" / "*.jsonl")
    whole = [json.dumps(entry(str(i), content="é" * i)) for i in range(6)]
    log.write_text(whole[0] + "\n\n" + whole[1] + "\r\n" + whole[2][:20])  # a partial last line
    stream = lambda: logs.entries(growing.stream(spark, glob, str(tmp_path / "state"))).select("segment", "uuid", "line_no")
    ids = lambda df: sorted(r.uuid for r in df.collect())
    assert ids(drain(spark, stream(), tmp_path, "x")) == ["0", "1"]
    late = logs.entries(growing.stream(spark, glob, str(tmp_path / "late"), skip_existing=True)).select("uuid")
    assert ids(drain(spark, late, tmp_path, "late")) == []
    with log.open("a") as f:
        f.write(whole[2][20:] + "\n" + whole[3] + "\n")
    (d / "b.jsonl").write_text(whole[4] + "\n")
    assert ids(drain(spark, stream(), tmp_path, "x")) == ["0", "1", "2", "3", "4"]
    assert ids(drain(spark, late, tmp_path, "late")) == ["2", "3", "4"]
    log.write_text(whole[5] + "\n")  # shorter now: nothing, and on from its new end
    assert ids(drain(spark, stream(), tmp_path, "x")) == ["0", "1", "2", "3", "4"]
    with log.open("a") as f:
        f.write(whole[0] + "\n")
    assert ids(drain(spark, stream(), tmp_path, "x")) == ["0", "0", "1", "2", "3", "4"]
    log.write_text(whole[1] + "\n" + whole[2] + "\n" + whole[3] + "\n")  # another file, longer than what was read
    assert ids(drain(spark, stream(), tmp_path, "x")) == ["0", "0", "1", "1", "2", "2", "3", "3", "4"]
    assert ids(drain(spark, stream(), tmp_path, "anew")) == ["1", "2", "3", "4"]  # a new checkpoint starts over


def test_ranges_have_each_line_once(spark, tmp_path):
    lines = [json.dumps(entry(str(i), content="x" * (i * 7 % 90))) for i in range(200)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n" + lines[0])
    for size in (1, 13, 100, 1 << 20):
        got = [r for p in growing.ranges(str(tmp_path / "a.jsonl"), 0, growing.line_end(str(tmp_path / "a.jsonl")), size) for r in growing.read_range(p)]
        assert [r[4] for r in got] == lines and [r[3] for r in got] == sorted({r[3] for r in got})
    e = logs.entries(growing.lines(spark, str(tmp_path / "*.jsonl"), range_bytes=512))
    assert e.count() == 200 and growing.line_end(str(tmp_path / "a.jsonl")) == sum(len(x) + 1 for x in lines)
    (tmp_path / "none.jsonl").write_text("no end")
    assert growing.line_end(str(tmp_path / "none.jsonl")) == 0


def test_polls(spark):
    rows = [("p", "a", i, u, r) for i, (u, r) in enumerate([("1", "user"), ("2", "assistant"), ("2", "assistant"), ("3", "user"), ("4", "assistant")])]
    e = spark.createDataFrame(rows, "project string, segment string, line_no int, uuid string, role string")
    ids = lambda df: sorted(r.uuid for r in df.collect())
    first = tail.poll(e.where("line_no < 2"))
    seen = tail.mark_seen(None, e.where("line_no < 2"))
    assert ids(first) == ["1", "2"] and tail.seen_count(seen) == 2
    assert ids(tail.poll(e, seen)) == ["3", "4"] and ids(tail.poll(e, seen, role="assistant")) == ["4"]
    assert ids(tail.poll(e, tail.mark_seen(seen, e))) == [] and tail.mark_seen(seen, e).count() == 4  # skipped roles count as seen


def test_a_repeated_call_id_keeps_the_older_open_call(spark):
    from test_logs import raw, result, use

    rows = [entry("a1", "assistant", [use("t", "Read")]), entry("a2", "assistant", [use("t", "Bash")]), entry("a3", content=[result("t", "one")]), entry("a4", content=[result("t", "two")]), entry("a5", content=[result("t", "three")]), {"type": "note", "uuid": "n"}]
    events = tail.events(logs.entries(raw(spark, a=rows)))
    assert sorted((r.uuid, r.result) for r in events.where(tail.is_update()).collect()) == [("a1", "two"), ("a2", "one")]
    assert sorted(r.uuid for r in tail.as_turn(events).collect()) == ["a1", "a1", "a2", "a2"] and [r.kind for r in tail.as_progress(events).collect()] == ["note"]
    assert events.select(tail.turn_id().alias("t")).where(F.col("t").isNull()).count() == 1


def test_rotations_as_they_arrive(spark, tmp_path):
    d = tmp_path / "proj"
    d.mkdir()
    (d / "a.jsonl").write_text(json.dumps(entry("1")) + "\n")
    (d / "b.jsonl").write_text("".join(json.dumps(entry(u, session=s)) + "\n" for u, s in (("2", "a"), ("3", "a"), ("4", "b"))))
    found = tail.rotation_events(logs.entries(growing.stream(spark, str(d / "*.jsonl"), str(tmp_path / "state"))))
    assert [tuple(r) for r in drain(spark, found, tmp_path, "r").collect()] == [("proj", "a", "b")]
    (d / "c.jsonl").write_text(json.dumps(entry("5", session="b")) + "\n")
    assert sorted(tuple(r) for r in drain(spark, found, tmp_path, "r").collect()) == [("proj", "a", "b"), ("proj", "b", "c")]


def test_many_files_are_looked_at_and_few_opened(tmp_path, monkeypatch):
    """100,000 files; what a batch takes is bounded, and every byte is taken once."""
    for i in range(100):
        (tmp_path / f"{i:02d}").mkdir()
        for j in range(1000):
            (tmp_path / f"{i:02d}" / f"{j:03d}.jsonl").write_text("a\n")
    reader = growing._Stream(str(tmp_path / "*" / "*.jsonl"), 1 << 20, False, str(tmp_path / "state"), None)
    start = reader.initialOffset()
    first = reader.latestOffset()
    assert len(reader.partitions(start, first)) == 100_000 and len(str(first)) < 100
    for name in ("07/123", "42/000", "99/999"):
        with (tmp_path / f"{name}.jsonl").open("a") as f:
            f.write("more\n")
    opened, plain = set(), open
    monkeypatch.setattr("builtins.open", lambda file, *a: (opened.add(str(file)), plain(file, *a))[1])
    second = reader.latestOffset()
    assert sorted((r.file[-12:], r.start, r.stop) for r in reader.partitions(first, second)) == [("07/123.jsonl", 2, 7), ("42/000.jsonl", 2, 7), ("99/999.jsonl", 2, 7)]
    assert len([f for f in opened if f.endswith(".jsonl")]) == 3 and reader.latestOffset() == second


def test_batches_are_bounded_and_survive_a_restart(tmp_path):
    for name, lines in (("a", 100), ("b", 3), ("c", 50)):
        (tmp_path / f"{name}.jsonl").write_text("".join(f"{name}{i:03d}\n" for i in range(lines)))
    make = lambda: growing._Stream(str(tmp_path / "*.jsonl"), 1 << 20, False, str(tmp_path / "state"), 64)
    reader = make()
    at, got = reader.initialOffset(), []
    for k in range(200):
        if k % 7 == 3:
            reader = make()  # a restart finds what was written last
        now = reader.latestOffset()
        if now == at:
            break
        parts = reader.partitions(at, now)
        assert 0 < sum(p.stop - p.start for p in parts) <= 64
        got += [r[4] for p in parts for r in growing.read_range(p)]
        again = make().partitions(at, now)  # a repeated batch reads the same
        assert [(p.file, p.start, p.stop) for p in again] == [(p.file, p.start, p.stop) for p in parts]
        reader.commit(at)
        at = now
    assert sorted(got) == sorted(f"{n}{i:03d}" for n, m in (("a", 100), ("b", 3), ("c", 50)) for i in range(m))
    (tmp_path / "d.jsonl").write_text("x" * 500 + "\n")  # a line longer than a batch comes alone
    assert [(p.stop - p.start) for p in reader.partitions(at, reader.latestOffset())] == [501]
    assert len(list((tmp_path / "state").iterdir())) < growing.SNAPSHOT + 40
