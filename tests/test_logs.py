import json

from provmill.operators import assembly as A
from provmill.operators import derive
from provmill.sources import logs


def entry(uuid, role="user", content="hi", ts="2024-01-01T10:00:00Z", **more):
    e = {"uuid": uuid, "type": role, "timestamp": ts, "sessionId": more.pop("session", "a"), "message": {"role": role, "content": content}}
    e["message"].update(more.pop("message", {}))
    return e | more


def use(id, name, **input):
    return {"type": "tool_use", "id": id, "name": name, "input": input}


def result(id, content, **more):
    return {"type": "tool_result", "tool_use_id": id, "content": content} | more


def raw(spark, **segments):
    rows = [("proj", s, f"/x/proj/{s}.jsonl", i, e if isinstance(e, str) else json.dumps(e)) for s, es in segments.items() for i, e in enumerate(es)]
    return spark.createDataFrame(rows, "project string, segment string, file string, line_no int, line string")


def placed(e):
    from pyspark.sql import functions as F

    return logs.positions(e).withColumn("path_id", F.col("segment"))


TOOLS = [
    entry("u1", content="Fix it"),
    entry("u2", "assistant", [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "On it"}, use("t1", "Read", file_path="a.rs"), use("t2", "Edit", file_path="b.rs"), use("t3", "Bash", command="ls")], message={"model": "m", "usage": {"input_tokens": 10, "output_tokens": 5, "cache_read_input_tokens": 7}}),
    entry("u3", content=[result("t1", "text of a"), result("t2", [{"type": "text", "text": "x"}, {"type": "text", "text": "y"}], is_error=True)]),
    entry("u4", "assistant", [use("t4", "Task", prompt="go"), use("t5", "Write", file_path="c.rs"), use("t6", "Write", file_path="b.rs"), result("t5", "inline")], message={"usage": {"output_tokens": 1}}),
    entry("u5", content=[{"type": "text", "text": "beside"}, result("t3", "not merged")]),
    entry("u6", content=[result("t4", "done"), {"type": "novel", "x": 1}]),
]


def test_reading_is_robust(spark):
    r = raw(spark, a=["", "{bad", entry("k1"), {"type": "snapshot", "snapshot": {}}, entry("k2", content=[{"type": "novel"}]), entry("k3", content=[{"type": "text"}]), entry("k4", "wizard"), '{"type":"user","type":"user","uuid":"d"}', entry("k5", content=None), "  "])
    assert [x.uuid for x in logs.entries(r).orderBy("line_no").collect()] == ["k1", "k2", "k5"]
    assert {(x.line_no, x.error) for x in logs.entries(r, bad=True).collect()} == {(1, "not JSON"), (5, "message.content part"), (6, "message.role"), (7, "not JSON")}
    m = logs.metadata(r).first()
    assert m.message_count == 3 and m.started_at is not None
    assert logs.first_session_ids(r).first().session_id == "a"


def test_files(spark, tmp_path):
    d = tmp_path / "projects" / "-home-me-x"
    d.mkdir(parents=True)
    (d / "s1.jsonl").write_text("\n".join(map(json.dumps, TOOLS)) + "\n")
    (tmp_path / "history.jsonl").write_text('{"display":"Hello","timestamp":5,"pastedContents":{},"project":"/p"}\nbad\n{"display":"x","timestamp":"5"}\n')
    assert logs.project_dir(str(tmp_path), "/home/me_x") == str(d)
    e = logs.entries(logs.lines(spark, f"{d}/*.jsonl"))
    assert [r.uuid for r in e.orderBy("line_no").collect()] == [f"u{i}" for i in range(1, 7)] and e.first().segment == "s1"
    h = logs.history(spark, logs.history_file(str(tmp_path))).collect()
    assert [(r.display, r.timestamp, r.project) for r in h] == [("Hello", 5, "/p")]
    assert logs.history(spark, str(tmp_path / "none.jsonl")).count() == 0
    assert logs.from_offset(b"a\nb\nc", 0) == (["a", "b"], 4) and logs.from_offset(b"a\n", 9) == ([], 2)


def test_tool_results_find_their_calls(spark):
    e = placed(logs.entries(raw(spark, a=TOOLS)))
    turns = A.turns(e)
    assert [r.uuid for r in turns.orderBy("pos").collect()] == ["u1", "u2", "u4", "u5"]
    got = {r.id: (r.category, r.result and (r.result.content, r.result.is_error)) for r in A.tool_calls(turns).collect()}
    assert got == {"t1": ("file_read", ("text of a", False)), "t2": ("file_write", ("x\ny", True)), "t3": ("shell", None), "t4": ("delegation", ("done", False)), "t5": ("file_write", ("inline", False)), "t6": ("file_write", None)}
    assert [(r.agent_id, r.prompt, r.result) for r in A.delegations(turns).collect()] == [("t4", "go", "done")]
    assert turns.where("environment is not null").count() == 0
    where = A.turns(placed(logs.entries(raw(spark, a=[entry("w", cwd="/x"), entry("v", gitBranch="b"), entry("u")]))))
    assert [(r.environment and (r.environment.working_dir, r.environment.branch)) for r in where.orderBy("pos").collect()] == [("/x", None), (None, "b"), None]
    v = A.views(turns).first()
    assert (v.n_turns, v.input_tokens, v.output_tokens, v.cache_read_tokens, v.cache_write_tokens, v.files_changed) == (4, 10, 6, 7, None, ["b.rs", "c.rs"])
    assert A.errors(e).count() == 1 and A.uses_tool(e, "Bash").count() == 1
    assert {r.uuid for r in A.with_text(e, "TEXT OF").collect()} == {"u3"} and A.with_text(e, "hm").count() == 0
    assert turns.where("uuid = 'u2'").first().thinking == "hm"


def test_repeated_call_ids(spark):
    rows = [entry("a1", "assistant", [use("t", "Read")]), entry("a2", "assistant", [use("t", "Bash")]), entry("a3", content=[result("t", "one")]), entry("a4", content=[result("t", "two")]), entry("a5", content=[result("t", "three")])]
    turns = A.turns(placed(logs.entries(raw(spark, a=rows))))
    assert {(r.name, r.result.content) for r in A.tool_calls(turns).collect()} == {("Bash", "one"), ("Read", "two")}


def test_chains(spark):
    r = raw(spark, a=[entry("1"), entry("2")], b=[entry("3", session="a"), entry("4", session="b", ts="2024-01-02T00:00:00Z")], c=[entry("5", session="b"), entry("6", session="c")], d=[entry("7", session="other")])
    first = logs.first_session_ids(r)
    got = A.chained_entries(logs.entries(r), first)
    assert [(x.path_id, x.uuid) for x in got.orderBy("path_id", "pos").collect()] == [("proj/a", "1"), ("proj/a", "2"), ("proj/a", "4"), ("proj/a", "6"), ("proj/d", "7")]
    m = {x["head"]: (x.message_count, x.n_segments) for x in A.chain_metadata(logs.metadata(r), first).collect()}
    assert m == {"proj/a": (6, 3), "proj/d": (1, 1)}


def test_cycle_of_segments(spark):
    from provmill.operators.chains import chains

    segments = spark.createDataFrame([(x,) for x in "abcdef"], "segment string")
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("e", "d"), ("f", "f")], "pred string, succ string")
    assert sorted(tuple(r) for r in chains(segments, links).collect()) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("e", "d", 1), ("e", "e", 0), ("f", "f", 0)]


def test_conversation_steps(spark):
    side = entry("side0000x", "assistant", "aside", parentUuid="u1", isSidechain=True)
    e = placed(logs.entries(raw(spark, a=[TOOLS[0], side, *TOOLS[1:], entry("sys", "system", "s")])))
    steps = derive.conversation_steps(e)
    got = {r.step_id: r for r in steps.collect()}
    assert set(got) == {"step-u1", "step-side0000", "step-u2", "step-u4", "step-u5"}
    assert got["step-side0000"].parents == ["step-u1"] and got["step-u2"].parents == ["step-u1"] and got["step-u4"].parents == ["step-u2"]
    assert got["step-u2"].actor == "agent:m" and set(got["step-u2"].change) == {"convo://a", "b.rs"}
    assert derive.conversation_heads(steps).first().head == "step-u5"


def test_lines_are_parsed_once(spark):
    """A filter on what parsing found doesn't repeat the parsing for each use of it."""
    raw = spark.createDataFrame([("p", "s", "f", 0, '{"type":"user","uuid":"u","timestamp":"t"}')], "project string, segment string, file string, line_no int, line string")
    for made in (logs.entries(raw), logs.entries(raw, bad=True)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parseJson(line") == 1, plan


def test_conversations_are_searched_in_one_pass(spark):
    raw = spark.createDataFrame([("p", s, "f", 0, '{"type":"user","uuid":"%s","timestamp":"2024-01-01T00:00:00Z","message":{"role":"user","content":"Say %s"}}' % (s, s)) for s in ("one", "two")], "project string, segment string, file string, line_no int, line string")
    e = logs.positions(logs.entries(raw)).selectExpr("*", "segment AS path_id")
    found = A.find_conversations(e, "SAY ONE")
    assert [r.path_id for r in found.collect()] == ["one"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parseJson(line") == 1


def test_turns_read_their_entries_by_column(spark):
    """Calls and results of one id meet in one shuffle: neither is read again for each join."""
    rows = [entry("a", role="assistant", content=[{"type": "tool_use", "id": "t", "name": "Bash", "input": {}}]), entry("b", content=[{"type": "tool_result", "tool_use_id": "t", "content": "1"}]), entry("c", content=[{"type": "tool_result", "tool_use_id": "t", "content": "2"}])]
    made = A.turns(placed(logs.entries(raw(spark, a=rows))))
    assert [r.result.content for r in A.tool_calls(made).collect()] == ["1"]
    several = placed(logs.entries(raw(spark, a=TOOLS, b=rows)))
    assert sorted(map(str, A.calls_of(several).collect())) == sorted(map(str, A.tool_calls(A.turns(several)).collect()))
    plan = A.tool_calls(made)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2 and plan.count("LogicalRDD") == 0, plan


def test_chained_entries_are_parsed_once(spark):
    lines = raw(spark, a=[entry("a", sessionId="a")], b=[entry("x", sessionId="a"), entry("y", sessionId="b")])
    first = logs.first_session_ids(lines)
    e = logs.entries(lines)
    bounds = A.merged_bounds(A.chained_entries(e, first), logs.metadata(lines, e.persist()), first)
    assert [r.head.rpartition("/")[2] for r in bounds.collect()] == ["a"]
    for made in (A.chained_entries(logs.entries(lines), first), A._chain_of(logs.metadata(lines), first)):
        assert "parseJson(" not in made._jdf.queryExecution().optimizedPlan().toString()
