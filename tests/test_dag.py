import random

import pytest
from pyspark.sql import functions as F

from provmill.functions import table_functions
from provmill.operators import dag
from provmill.operators import steps as S

SCHEMA = "path_id string, pos int, step_id string, parents array<string>"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def ids(df, *cols):
    return sorted(tuple(r) for r in df.select(*(cols or ("path_id", "step_id"))).collect())


FORK = [("p", 0, "s1", []), ("p", 1, "s2", ["s1"]), ("p", 2, "s2a", ["s1"]), ("p", 3, "s3", ["s2"])]


def test_fork(spark):
    steps, heads = frame(spark, FORK), spark.createDataFrame([("p", "s3")], "path_id string, head string")
    assert ids(dag.ancestors(steps, heads), "step_id") == [("s1",), ("s2",), ("s3",)]
    assert ids(dag.dead_ends(steps, heads), "step_id") == [("s2a",)]
    assert ids(dag.roots(steps), "step_id") == [("s1",)]
    assert ids(dag.children(steps), "step_id", "child") == [("s1", "s2"), ("s1", "s2a"), ("s2", "s3")]
    assert ids(dag.active_edges(steps, heads), "child", "active") == [("s2", True), ("s2a", False), ("s3", True)]
    assert ids(dag.degrees(steps), "step_id", "n_parents", "n_children") == [("s1", 0, 2), ("s2", 1, 1), ("s2a", 1, 0), ("s3", 1, 0)]


def test_edge_cases(spark):
    steps = frame(spark, [*FORK, ("c", 0, "a", ["b"]), ("c", 1, "b", ["a"]), ("d", 0, "x", []), ("d", 1, "y", ["gone"]), ("e", 0, "z", ["u"]), ("e", 1, "u", []), ("e", 2, "z", ["v"]), ("e", 3, "v", [])])
    heads = spark.createDataFrame([("p", "nowhere"), ("c", "a"), ("d", "y"), ("e", "z"), ("n", None)], "path_id string, head string")
    closed = {p: {s for q, s in ids(dag.ancestor_ids(steps, heads)) if q == p} for p in "pcde"}
    assert closed == {"p": {"nowhere"}, "c": {"a", "b"}, "d": {"y", "gone"}, "e": {"z", "v"}}
    assert {s for p, s in ids(dag.dead_ends(steps, heads)) if p == "p"} == {"s1", "s2", "s2a", "s3"}
    assert ids(dag.ancestors(steps, heads).where("path_id = 'd'")) == [("d", "y")]
    with pytest.raises(ValueError):
        dag.dead_ends(steps, heads.where("path_id <> 'p'"), need_head=True)
    empty = frame(spark, [])
    assert ids(dag.dead_ends(empty, heads)) == []


def test_plans_agree(spark):
    rng = random.Random(5)
    rows, heads = [], []
    for p in range(6):
        n = rng.randint(1, 25)
        rows += [(f"p{p}", i, f"s{i}", sorted({f"s{rng.randrange(i)}" for _ in range(rng.randint(0, 2))}) if i else []) for i in range(n)]
        heads.append((f"p{p}", f"s{rng.randrange(n)}"))
    steps, heads = frame(spark, rows), spark.createDataFrame(heads, "path_id string, head string")
    a, b, c, e = (ids(f(steps, heads)) for f in (dag.closure_in_tasks, dag.closure_by_levels, dag.closure_by_cte, lambda *x: dag.closure_by_blocks(*x, 6)))
    assert a == b == c == e
    assert ids(dag.ancestor_ids(steps, heads, most_steps=10)) == a
    assert len(ids(dag.ancestors(steps, heads))) + len(ids(dag.dead_ends(steps, heads))) == len(rows)


def test_marks_agree_with_closures(spark):
    rng = random.Random(9)
    rows = [(f"p{p}", i, f"s{i % 17}", sorted({f"s{rng.randrange(20)}" for _ in range(rng.randint(0, 3))})) for p in range(5) for i in range(20)]
    steps, heads = frame(spark, rows), spark.createDataFrame([(f"p{p}", h) for p in range(4) for h in ("s3", "s9" if p else None)], "path_id string, head string")
    on = set(ids(dag.ancestor_ids(steps, heads)))
    for most in (1000, 10):  # in tasks, and over the cluster
        got = dag.marked(steps, heads, most_steps=most).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.active == ((r.path_id, r.step_id) in on) and r.headed == (r.path_id != "p4")
            assert r.active_parents == [(r.path_id, x) in on for x in r.parents]
    assert [tuple(r) for r in dag.headless(steps, heads).collect()] == [("p4", 20)]


def test_a_long_path_over_the_cluster(spark):
    n = 100_000
    steps = spark.range(n).select(F.lit("p").alias("path_id"), F.col("id").cast("int").alias("pos"), F.concat(F.lit("s"), "id").alias("step_id"), F.when(F.col("id") > 0, F.array(F.concat(F.lit("s"), F.col("id") - 1))).otherwise(F.array().cast("array<string>")).alias("parents"))
    heads = spark.createDataFrame([("p", f"s{n - 10}")], "path_id string, head string")
    assert dag.ancestor_ids(steps, heads, most_steps=1000).count() == n - 9
    assert dag.ancestors(steps, heads).count() == n - 9


def test_second_parents_over_the_cluster(spark, monkeypatch):
    """A path of 100,000 steps that hang together by second parents, their first being gone, and a ring across blocks."""
    monkeypatch.setattr(dag, "closure_by_levels", None)
    n, step = 100_000, lambda c: F.concat(F.lit("s"), c)
    i = F.col("id")
    parents = F.when(i == 0, F.array(step(F.lit(n - 1)))).when(i % 7 == 0, F.array(F.concat(F.lit("gone"), i), step(i - 1), step(i - 5))).otherwise(F.array(F.concat(F.lit("gone"), i), step(i - 1)))
    steps = spark.range(n).select(F.lit("p").alias("path_id"), i.cast("int").alias("pos"), step(i).alias("step_id"), F.when(i == 50_000, F.array().cast("array<string>")).otherwise(parents).alias("parents"))
    steps = steps.unionByName(spark.createDataFrame([("q", 0, "a", ["b"]), ("q", 1, "b", ["a"]), ("q", 2, "c", [])], SCHEMA))
    heads = spark.createDataFrame([("p", f"s{40_000}"), ("q", "a")], "path_id string, head string")
    got = dag.ancestor_ids(steps, heads, most_steps=3_000)
    want, stack = set(), [40_000]
    while stack:
        k = stack.pop()
        if k not in want:
            want.add(k)
            stack += [] if k == 50_000 else [n - 1] if k == 0 else [k - 1, k - 5] if k % 7 == 0 else [k - 1]
    assert ids(got.where("path_id = 'q'"), "step_id") == [("a",), ("b",)]
    found = {r.step_id for r in got.where("path_id = 'p'").collect()}
    assert found == {f"s{k}" for k in want} | {f"gone{k}" for k in want if k not in (0, 50_000)}


def test_filters_keep_steps_with_equal_ids(spark):
    rows = [("p", 0, "s", "human:a", "2024-01-01T10:00:00Z", "f"), ("p", 1, "s", "agent:b", "2024-01-01T12:00:00Z", "g"), ("p", 2, "t", "human:a", "2024-01-01T14:00:00Z", "g")]
    steps = spark.createDataFrame(rows, "path_id string, pos int, step_id string, actor string, ts string, artifact string")
    assert ids(S.where(steps, actor="human:", artifact="g"), "pos") == [(0,), (1,), (2,)]
    assert ids(S.where_unique(steps, actor="human:", artifact="g"), "pos") == [(2,)]
    assert ids(S.by_time(steps, "2024-01-01T12:00:00Z", "2024-01-01T14:00:00Z"), "pos") == [(1,), (2,)]
    assert ids(S.by_time(steps, "2024-01-01T12:00:00Z", "2024-01-01T14:00:00+00:00", instants=True), "pos") == [(1,), (2,)]
    assert ids(S.by_actor(steps, "human:%"), "pos") == []


def test_correlation_twice_is_once(spark):
    steps = spark.createDataFrame([("p", "1", "r"), ("q", "2", "r"), ("q", "3", "x"), ("w", "4", None)], "path_id string, step_id string, revision string")
    links = S.correlate(steps)
    once = S.add_refs(steps, links)
    twice = S.add_refs(once, links)
    key = lambda d: sorted((r.path_id, r.step_id, [(x.rel, x.href) for x in r.refs]) for r in d.collect())
    assert key(once) == key(twice)
    assert dict((k[1], k[2]) for k in key(once)) == {"1": [("same-change", "path:q/2")], "2": [("same-change", "path:p/1")], "3": [], "4": []}


def test_a_revision_of_many_steps_comes_in_parts(spark, monkeypatch):
    """References and relations are the same however many steps a row may list."""
    rows = [(f"p{i % 9}", f"{i}", ("agent:x", "human:y")[i % 9 % 2], None if i % 9 == 4 and i > 30 else ("hot", "cold", f"own{i}")[min(i % 5, 2)]) for i in range(60)]
    steps = spark.createDataFrame([*rows, ("p0", "n", "human:y", None)], "path_id string, step_id string, actor string, revision string")

    def made():
        hubs = S.correlate(steps)
        refs = S.add_refs(steps, hubs).collect()
        return sorted((r.path_id, r.step_id, [x.href for x in r.refs]) for r in refs), ids(S.related_paths(steps, hubs), "path_id", "rel", "other"), hubs.count()

    whole = made()
    monkeypatch.setattr(S, "PART", 3)
    assert made() == whole
    of = {(p, s): r for p, s, _, r in rows}
    want = {k: sorted(f"path:{p}/{s}" for (p, s), r in of.items() if r and r == of[k] and p != k[0]) for k in of}
    assert {(p, s): h for p, s, h in whole[0] if s != "n"} == want and len(whole[0]) == 61
    assert {(a, b) for a, _, b in whole[1]} == {(k[0], h.split("/")[0][5:]) for k, v in want.items() for h in v}
    assert whole[2] == sum(bool(v) for v in want.values()) and S.pairs(S.correlate(steps)).count() == sum(map(len, want.values())) // 2


def test_base_by_prefix(spark):
    paths = spark.createDataFrame([("g", "p", "abcdef0123"), ("g", "q", "12345678zz"), ("g", "r", "none")], "graph_id string, path_id string, base_ref string")
    steps = spark.createDataFrame([("g", "o", 0, 0, "s1", "abcdef0123"), ("g", "o", 0, 1, "s2", "12345678yy")], "graph_id string, path_id string, path_pos int, pos int, step_id string, revision string")
    assert ids(S.base_steps(paths, steps), "path_id", F.coalesce("base_step", F.lit("-"))) == [("p", "s1"), ("q", "s2"), ("r", "-")]


def test_actors_without_a_definition_keep_their_own_name(spark):
    steps = spark.createDataFrame([("p", "1", "agent:x"), ("p", "2", "human:y"), ("p", "3", None)], "path_id string, step_id string, actor string")
    names = spark.createDataFrame([("agent:x", "Ex")], "actor string, name string")
    assert ids(S.resolve_actors(steps, names).na.fill("-"), "step_id", "actor_name") == [("1", "Ex"), ("2", "y"), ("3", "-")]


def test_relations_of_paths(spark):
    steps = spark.createDataFrame([("a", "1", "agent:x", "r"), ("a", "2", "human:y", None), ("b", "3", "human:z", "r"), ("c", "4", "human:z", "q"), ("d", "5", "human:w", "q")], "path_id string, step_id string, actor string, revision string")
    relations = S.related_paths(steps, S.correlate(steps))
    assert ids(relations, "path_id", "rel", "other") == [("a", "produces", "b"), ("b", "produced-by", "a"), ("c", "complements", "d"), ("d", "complements", "c")]
    paths = spark.createDataFrame([("g", "a"), ("g", "b"), ("h", "e")], "graph_id string, path_id string")
    assert ids(S.correlated_graphs(paths, S.correlate(steps)), "graph_id", "rel", "href") == [("g", "correlates", "self")]


def test_ancestors_as_a_table_function(spark):
    rows = [("p", "a", None, 0, None), ("p", "b", ["a"], 1, None), ("p", "c", ["gone"], 2, "c"), ("p", "c", ["b", "x"], 3, "c"), ("p", "d", ["a"], 4, None)]
    rows += [("q", "e", ["f"], 0, "e"), ("q", "f", ["e", None], 1, "zz"), ("r", "g", [], 0, None), (None, "h", None, 0, "h")]
    spark.createDataFrame(rows, "path_id string, step_id string, parents array<string>, pos int, head string").createOrReplaceTempView("__some_steps")
    table_functions.register(spark)
    ask = lambda t: sorted(map(tuple, spark.sql(f"SELECT * FROM ancestors(TABLE({t}) PARTITION BY path_id ORDER BY pos)").collect()), key=str)
    assert ask("__some_steps") == sorted([("p", "a"), ("p", "b"), ("p", "c"), ("p", "x"), ("q", "e"), ("q", "f"), ("q", "zz"), (None, "h")], key=str)
    assert ask("SELECT * FROM __some_steps WHERE pos > 9") == []
