import json

from provmill.streaming import tail
from test_logs import entry, result, use


def run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None
    return q


def test_seen_entries_come_once(spark, tmp_path):
    d = tmp_path / "proj"
    d.mkdir()
    (d / "a.part0.jsonl").write_text("\n".join(map(json.dumps, [entry("1"), entry("2", "assistant", "x")])))
    (d / "a.part1.jsonl").write_text("\n".join(map(json.dumps, [entry("2", "assistant", "x"), entry("3", "assistant", [use("q", "Bash")]), entry("4", content=[result("q", "r")])])))
    run(tail.first_seen(tail.entries(spark, str(tmp_path / "*"), max_files=1), role="assistant").select("uuid"), "seen")
    assert sorted(r.uuid for r in spark.table("seen").collect()) == ["2", "3"]
    first = spark.createDataFrame([("p", "b", "a"), ("p", "a", "a")], "project string, segment string, session_id string")
    assert [tuple(r) for r in tail.rotations(first).collect()] == [("p", "a", "b")]
