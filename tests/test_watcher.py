import itertools
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from provmill.sources import logs
from provmill.streaming import growing, tail, watcher
from test_logs import TOOLS, entry, raw, result, use


@pytest.fixture(scope="module")
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, watcher.STORE)
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.set(key, before)


class Run:
    """A stream over growing files whose events are kept by batch."""

    def __init__(self, spark, folder, make):
        self.spark, self.folder, self.make = spark, folder, make
        (folder / "logs" / "proj").mkdir(parents=True)

    def add(self, segment, *entries):
        with (self.folder / "logs" / "proj" / f"{segment}.jsonl").open("a") as f:
            f.writelines(json.dumps(e) + "\n" for e in entries)

    def go(self):
        """What came new, in order."""
        stream = self.make(logs.entries(growing.stream(self.spark, str(self.folder / "logs" / "*" / "*.jsonl"), str(self.folder / "tail"))))
        kept, new = watcher.Kept(str(self.folder / "kept")), []

        def each(batch, batch_id):
            kept.save(batch, batch_id)
            new.extend(watcher.in_order(kept.delta(batch.sparkSession, stream.schema, batch_id)).collect())

        q = stream.writeStream.foreachBatch(each).option("checkpointLocation", str(self.folder / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None
        return new


def short(rows):
    return [(r.event, r.segment, r.uuid, r.text or r.result) for r in rows]


def test_results_are_paired_over_batches_and_calls_expire(rocks, tmp_path):
    run = Run(rocks, tmp_path, lambda e: watcher.watch(e, patience_ms=1500))
    run.add("a", *TOOLS[:2])
    assert short(run.go()) == [("turn", "a", "u1", "Fix it"), ("turn", "a", "u2", "On it")]
    run.add("a", TOOLS[1], *TOOLS[2:3])  # one entry again
    assert short(run.go()) == [("turn_updated", "a", "u2", "text of a"), ("turn_updated", "a", "u2", "x\ny")]
    time.sleep(1.6)
    run.add("b", {"type": "hook", "uuid": "z", "timestamp": "2024-01-01T00:00:00Z", "data": {"name": "pre-commit"}, "level": 2})
    got = run.go()
    assert short(got) == [("progress", "b", "z", "hook"), ("call_expired", "a", "u2", None)] and got[1].call_id == "t3"
    assert json.loads(got[0].data) == {"uuid": "z", "timestamp": "2024-01-01T00:00:00Z", "extra": {"data": {"name": "pre-commit"}, "level": 2}}
    run.add("a", entry("u9", content=[result("t3", "too late")]))
    assert run.go() == []


def test_a_stream_starts_from_a_table_of_seen_ids(rocks, tmp_path):
    seen = rocks.createDataFrame([("proj", "a", "1"), ("proj", "b", "2")], "project string, segment string, uuid string")
    run = Run(rocks, tmp_path, lambda e: watcher.watch(e, role="assistant", seen=seen))
    run.add("a", entry("1", "assistant", "x"), entry("2", "assistant", "y"), entry("3"), entry("4", "assistant", "bridge", session="z"))
    assert [r[2] for r in short(run.go())] == ["2"]
    run.add("a", entry("3", "assistant", "seen in another role"), entry("5", "assistant", "n"))
    assert [r[2] for r in short(run.go())] == ["5"]


@pytest.mark.parametrize("order", [("c", "a", "b"), ("b", "c", "a")])
def test_segments_in_any_order_make_one_chain(rocks, tmp_path, order):
    lines = {"a": [entry("1")], "b": [entry("2", session="a"), entry("3", session="b")], "c": [entry("4", session="b"), entry("5", session="c")]}
    run, events = Run(rocks, tmp_path, watcher.chain_events), []
    for name in order:
        run.add(name, *lines[name])
        events.append(run.go())
    told = [json.loads(r.data) for r in itertools.chain(*events) if r.event == "progress"]
    assert sorted((x["from"], x["to"]) for x in told) == [("a", "b"), ("b", "c")]
    all_events = rocks.read.schema(tail.EVENT + ", batch long").option("basePath", str(tmp_path / "kept")).parquet(str(tmp_path / "kept"))
    assert sorted((r.segment, r.head, r.ord) for r in watcher.places(all_events).collect()) == [("a", "a", 0), ("b", "a", 1), ("c", "a", 2)]


def test_rotation_comes_before_the_turns_of_its_batch(rocks, tmp_path):
    run = Run(rocks, tmp_path, lambda e: watcher.watch(e).unionByName(watcher.chain_events(e)))
    run.add("a", entry("1"))
    assert [r.event for r in run.go() if r.event != "chained"] == ["turn"]
    run.add("b", entry("0", content="bridge", session="a"), entry("2", content="New", session="b"))
    got = [r for r in run.go() if r.event != "chained"]
    assert [(r.event, r.text) for r in got] == [("progress", watcher.ROTATED), ("turn", "New")] and json.loads(got[0].data) == {"from": "a", "to": "b"}


def test_a_later_name_and_a_ring(rocks, tmp_path):
    """The last name by order continues a segment, whenever it came; a ring has its least segment as head.  As in batch."""
    from provmill.operators import chains

    run = Run(rocks, tmp_path, watcher.chain_events)
    run.add("a", entry("1"))
    run.add("b", entry("2", session="a"))
    run.add("b2", entry("3", session="b"))
    run.add("y", entry("4", session="x"))
    run.go()
    run.add("c", entry("5", session="a"))
    run.add("x", entry("6", session="y"))
    run.add("self", entry("7", session="self"))
    run.go()
    events = rocks.read.schema(tail.EVENT + ", batch long").option("basePath", str(tmp_path / "kept")).parquet(str(tmp_path / "kept"))
    got = sorted((r.segment, r.head, r.ord) for r in watcher.places(events).collect())
    first = logs.first_session_ids(growing.lines(rocks, str(tmp_path / "logs" / "*" / "*.jsonl")).withColumn("line_no", F.lit(0)))
    want = chains.chains(first.select("segment"), chains.links(first))
    assert got == sorted((r.segment, r["head"], r.ord) for r in want.collect())


def test_delta_and_whole(rocks, tmp_path):
    log, told = tmp_path / "logs" / "proj", []
    log.mkdir(parents=True)

    def handle(delta, whole, batch_id):
        told.append((batch_id, sorted(r.uuid for r in delta.collect()), sorted((r.segment, r.uuid) for r in whole.collect())))

    def go():
        stream = tail.first_seen(logs.entries(growing.stream(rocks, str(log / "*.jsonl"), str(tmp_path / "tail")))).select("project", "segment", "uuid", "text", "extra")
        q = watcher.with_whole(stream, str(tmp_path / "kept"), handle).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None

    put = lambda name, *ids: (log / f"{name}.jsonl").open("a").writelines(json.dumps(entry(i, mark=i)) + "\n" for i in ids)
    put("a", "1", "2")
    put("b", "9")
    go()
    put("a", "2", "3")
    go()
    assert told[0][1:] == (["1", "2", "9"], [("a", "1"), ("a", "2"), ("b", "9")])
    assert told[1][1:] == (["3"], [("a", "1"), ("a", "2"), ("a", "3")])
    # the last batch once more, as after a crash before its commit
    commits = sorted((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for f in (tmp_path / "state" / "commits").glob(f"*{commits[-1].name}*"):
        f.unlink()
    go()
    assert told[2] == told[1] and len(told) == 3


def test_fields_that_have_no_column(spark):
    rows = [entry("u1", subtype="init", version="1", nested={"b": [1, None], "a": "é"}), entry("u2"), entry("u3", version=3), {"type": "progress", "uuid": "p", "data": {"type": "hook"}}]
    e = logs.entries(raw(spark, a=rows))
    got = {r.uuid: (r.version, r.extra and json.loads(r.extra)) for r in e.select("uuid", "version", F.to_json("extra").alias("extra")).collect()}
    assert got == {"u1": ("1", {"subtype": "init", "nested": {"b": [1, None], "a": "é"}}), "u2": (None, None), "p": (None, {"data": {"type": "hook"}})}
    assert [json.loads(r.data) for r in tail.as_progress(tail.events(e)).collect()] == [{"uuid": "p", "timestamp": "", "extra": {"data": {"type": "hook"}}}]
    from provmill.operators import assembly
    from test_logs import placed

    turns = assembly.turns(placed(e)).select("uuid", F.try_variant_get("extra", "$.subtype", "string").alias("s")).collect()
    assert sorted((r.uuid, r.s) for r in turns) == [("u1", "init"), ("u2", None)]


def test_events_as_a_stream_and_at_once_are_the_same(rocks, tmp_path):
    run = Run(rocks, tmp_path, watcher.watch)
    some = [entry("a1", "assistant", [use("t", "Read")]), entry("a2", "assistant", [use("t", "Bash")]), entry("a3", content=[result("t", "one")]), entry("a4", content=[result("t", "two")]), entry("a5", content=[result("t", "three")])]
    for k in range(0, 5, 2):
        run.add("a", *some[k : k + 2])
        run.add("b", *TOOLS[k : k + 2])
        run.go()
    plain = lambda rows: sorted((tuple(r) for r in rows.select("segment", "event", "uuid", "call_id", "result").collect()), key=str)
    kept = rocks.read.schema(tail.EVENT + ", batch long").option("basePath", str(tmp_path / "kept")).parquet(str(tmp_path / "kept"))
    whole = logs.entries(raw(rocks, a=some, b=[e | {"sessionId": "b"} for e in TOOLS]))
    assert plain(kept.where("segment = 'a'")) == plain(tail.events(whole).where("segment = 'a'"))


class _Store:
    """A state variable of one segment in memory, which counts its trips."""

    def __init__(self):
        self.rows, self.whole, self.trips = {}, None, 0

    def _trip(self, result=None):
        self.trips += 1
        return result

    def get(self):
        return self._trip(self.whole)

    def update(self, value):
        self.whole = self._trip(value)

    def exists(self):
        return self._trip(bool(self.rows))

    def containsKey(self, key):
        return self._trip(key in self.rows)

    def getValue(self, key):
        return self._trip(self.rows[key])

    def updateValue(self, key, value):
        self.rows[self._trip(key)] = value

    def removeKey(self, key):
        del self.rows[self._trip(key)]

    def iterator(self):
        return self._trip(iter(sorted(self.rows.items())))


@pytest.mark.parametrize("held", [0, 2, 1000])
def test_a_segment_is_held_in_one_value_or_goes_to_the_maps(monkeypatch, held):
    """Whatever is held, the same entries are new and results find the same turns; what is held takes a trip each way a batch."""
    monkeypatch.setattr(watcher, "HELD", held)
    dice, value, seen, calls = random.Random(held), _Store(), _Store(), _Store()
    known, open_, n, due_at = set(), tail.OpenCalls(), 0, []
    for batch in range(60):
        at = watcher._Held(value, seen, calls, 5, due_at.append)
        at.now = batch
        for _ in range(dice.randrange(8)):
            uuid, call = f"u{dice.randrange(80)}", f"c{dice.randrange(6)}"
            assert at.see(uuid) == (uuid not in known)
            known.add(uuid)
            if dice.random() < 0.6:
                n += 1
                at.open(call, f"{batch} {n}")
                open_.open(call, f"{batch} {n}")
            else:
                assert at.close(call) == open_.close(call)
        if batch % 7 == 6:
            old = [(c, t) for c, ts in open_.turns.items() for t in ts if int(t.split()[0]) + 5 <= batch]
            assert sorted(at.expired(batch)) == sorted(old) and len(due_at) == len(set(due_at))
            open_.turns = {c: left for c, ts in open_.turns.items() if (left := [t for t in ts if (c, t) not in old])}
        at.store()
    if held == 1000:
        assert value.trips <= 120 and seen.trips + calls.trips <= 2 * 60 and not seen.rows and not calls.rows
    else:
        assert seen.rows
    older = _Store()
    older.rows = {("u",): (1,)}
    assert not watcher._Held(_Store(), older, _Store(), None, None).see("u")  # a stream that began with the maps alone
