import json
import os
import random

import pytest
from pyspark.sql import functions as F

from provmill.sources import documents as D
from provmill.sources import line_files, paged
from provmill.streaming import growing


def names(folder):
    return sorted(p.name for p in folder.iterdir())


def test_lines_as_files(spark, tmp_path):
    rows = spark.range(0, 20_000).select(F.concat(F.lit("f"), F.col("id") % 7).alias("doc"), F.col("id").alias("n"), F.concat(F.lit("é "), "id").alias("line")).repartition(5)
    line_files.write_lines(rows, str(tmp_path), "doc", "n")
    assert names(tmp_path) == [f"f{i}" for i in range(7)]
    assert (tmp_path / "f3").read_text() == "".join(f"é {i}\n" for i in range(3, 20_000, 7))
    line_files.write_lines(rows.where("n < 7"), f"file://{tmp_path}", "doc", "n")  # again: replaced
    assert (tmp_path / "f3").read_text() == "é 3\n"


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    (tmp_path / "a").write_text("old\n")
    bad = spark.createDataFrame([("a", "new"), ("b", "new"), ("../c", "new")], "doc string, line string")
    with pytest.raises(Exception, match="can't be a file's name"):
        line_files.write_lines(bad, str(tmp_path), "doc")
    assert names(tmp_path) == ["a"] and (tmp_path / "a").read_text() == "old\n"


def test_retried_tasks_leave_no_second_file(tmp_path):
    """A task that is run again writes to other places; only what is committed gets its name."""
    w = line_files._Writer(str(tmp_path))
    lost = w.write(iter([("a", "1"), ("b", "2")]))
    kept = w.write(iter([("a", "1"), ("b", "2")]))
    with pytest.raises(ValueError, match="don't come together"):
        w.write(iter([("a", "1"), ("b", "2"), ("a", "3")]))
    w.commit([kept, None])
    assert names(tmp_path) == ["a", "b"] and not any(os.path.exists(f) for f, _ in lost.files)
    with pytest.raises(ValueError, match="several tasks"):
        w.commit([w.write(iter([("a", "x")])), w.write(iter([("a", "y")]))])
    assert (tmp_path / "a").read_text() == "1\n"
    with pytest.raises(ValueError, match="isn't on a mount"):
        line_files._Writer("s3://bucket/x")


def test_documents_as_files(spark, tmp_path):
    from test_documents import PATH, docs

    d = docs(spark, a={"Path": PATH}, b={"Path": PATH | {"path": PATH["path"] | {"id": "other"}}})
    paths, steps = D.scoped(D.paths(d)), D.scoped(D.steps(d))
    line_files.write_lines(D.document_lines(paths, steps), str(tmp_path), "path_id", "section", "ord")
    whole = {r.path_id: json.loads(r.raw) for r in D.path_documents(paths, steps).collect()}
    assert len(whole) == 2 and {n: json.loads((tmp_path / n).read_text()) for n in names(tmp_path)} == whole
    step = {"Step": PATH["steps"][0]}
    more = docs(spark, s=step, a={"Path": PATH}, g={"Graph": {"graph": {"id": "g"}, "paths": [PATH, {"$ref": "x"}]}})
    for title in (None, "All"):
        out = tmp_path / f"merged-{title}"
        out.mkdir()
        line_files.write_lines(D.merged_lines(more, title), str(out), "graph_id", "section", "uri", "pos")
        merged = D.merge(more, title).first()
        assert names(out) == [merged.graph_id] and json.loads((out / merged.graph_id).read_text()) == json.loads(merged.raw)


def test_a_file_is_written_by_several_tasks(spark, tmp_path):
    """Pieces of a file, compressed or not, are strung together in the order of the partitions; a merged graph is dealt by ranges, and nothing of it is stored."""
    import gzip

    from test_documents import PATH, docs

    rows = spark.range(1000, numPartitions=7).select(F.lit("n").alias("f"), F.concat(F.lit("é"), F.col("id").cast("string")).alias("line"))
    line_files.write_in_order(rows, str(tmp_path), "f")
    line_files.write_in_order(rows, str(tmp_path), "f", packed=True)
    want = "".join(f"é{i}\n" for i in range(1000))
    assert names(tmp_path) == ["n", "n.gz"] and (tmp_path / "n").read_text() == want == gzip.decompress((tmp_path / "n.gz").read_bytes()).decode()
    assert spark.read.text(str(tmp_path / "n.gz")).count() == 1000
    graph = {"Graph": {"graph": {"id": "g"}, "paths": [PATH, {"$ref": "x"}]}}
    d = docs(spark, **{f"u{i:02d}": {"Path": PATH | {"path": {"id": str(i), "head": "third"}}} for i in range(40)}, a="{", b={"Graph": {"graph": {"id": "e"}, "paths": []}}).unionByName(docs(spark, u00=graph)).repartition(5)
    merged = D.merged_lines(d)
    given = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")
    assert given(merged) == given(d) == 2
    out = tmp_path / "merged"
    out.mkdir()
    line_files.write_in_order(merged, str(out), "graph_id", packed=True)
    assert names(out) == ["graph-merged-42.gz"]
    got = json.loads(gzip.decompress((out / names(out)[0]).read_bytes()))["Graph"]["paths"]
    assert len(got) == 42 and [p["path"]["id"] for p in got[3:]] == [str(i) for i in range(1, 40)] and {"$ref": "x"} in got[:3]


def capture(folder, endpoint, pages, seed=None):
    lines = [json.dumps({"url": u, "link": f'<first>; rel="first", <{n}>; rel="next"' if n else '<x>; rel="last"', "body": b}) for u, n, b in pages]
    if seed is not None:
        random.Random(seed).shuffle(lines)
    (folder / paged.file_of(endpoint)).write_text("\n".join(lines) + "\n")


def test_pages_in_any_order(spark, tmp_path):
    pages = [(f"u{i}", f"u{i + 1}" if i < 9 else None, [{"n": 2 * i}, {"n": 2 * i + 1}]) for i in range(10)]
    for seed in range(3):
        capture(tmp_path, f"repos/o/r{seed}/pulls", pages, seed)
    capture(tmp_path, "object", [("o", None, {"total": 1})])
    got = paged.items(spark, str(tmp_path)).orderBy("endpoint", "page", "item").collect()
    for seed in range(3):
        own = [r for r in got if r.endpoint == f"repos/o/r{seed}/pulls"]
        assert [json.loads(r.value)["n"] for r in own] == list(range(20)) and [r.page for r in own] == [i // 2 for i in range(20)] and not any(r.problem for r in own)
    assert [(r.page, r.item, r.value) for r in got if r.endpoint == "object"] == [(0, 0, '{"total":1}')]


def test_lost_pages_and_loops_are_told(spark, tmp_path):
    capture(tmp_path, "lost", [("a", "b", [1]), ("c", None, [3])])
    capture(tmp_path, "ring", [("a", "b", [1]), ("b", "a", [2])])
    capture(tmp_path, "self", [("a", "a", [1])])
    capture(tmp_path, "twice", [("a", "b", ["old"]), ("a", None, ["new"]), ("b", None, None)])
    with (tmp_path / "self.jsonl").open("a") as f:
        f.write('not JSON\n\n{"no":"url"}\n')
    of = lambda e: sorted(((r.page, r.value, r.url if r.problem else None, r.problem) for r in paged.items(spark, str(tmp_path)).where(F.col("endpoint") == e).collect()), key=str)
    assert of("lost") == [(0, "1", None, None), (0, None, "b", "lost"), (1, "3", None, None)]
    assert of("ring") == [(0, "1", None, None), (1, "2", None, None), (1, None, "a", "loop")]
    assert sorted(x[3] or "" for x in of("self")) == ["", "loop", "unreadable", "unreadable"]
    assert [x[1] for x in of("twice")] == ['"new"']
    assert of("none") == []


def test_filters_leave_other_endpoints_alone(spark, tmp_path):
    capture(tmp_path, "a", [("u", None, [1])])
    (tmp_path / "b.jsonl").mkdir()  # can't be opened
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    try:
        assert [r.value for r in paged.items(spark, str(tmp_path)).where("endpoint = 'a' and page = 0").collect()] == ["1"]
        assert [r.value for r in paged.items(spark, str(tmp_path)).where("endpoint in ('a', 'c')").collect()] == ["1"]
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", False)


def test_a_task_reads_many_small_files(spark, tmp_path):
    """Each file is read once, whole, whichever task it goes to."""
    n = 600
    for i in range(n):
        (tmp_path / f"e{i:04d}.jsonl").write_text('{"url": "u%d", "body": [%d]}\n' % (i, i))
    logs_ = growing.lines(spark, str(tmp_path / "*.jsonl"))
    captured = paged.items(spark, str(tmp_path))
    assert logs_.rdd.getNumPartitions() == captured.rdd.getNumPartitions() == 3
    assert sorted(r.segment for r in logs_.collect()) == [f"e{i:04d}" for i in range(n)]
    assert sorted(int(r.value) for r in captured.collect()) == list(range(n))
    assert [len(x.parts) for x in growing.dealt(growing.ranges("f", 0, 25, 10), 10)] == [1, 1, 1]
