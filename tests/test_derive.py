import json

from provmill.functions import text as X
from provmill.operators import derive, track
from provmill.sources import captures


def test_pull_request(spark, tmp_path):
    d = tmp_path / "pr-7"
    d.mkdir()
    (d / "pull.json").write_text(json.dumps({"number": 7, "title": "T", "body": "Fixes #3, closes #5 and fixes #3", "base": {"ref": "dev", "repo": {"name": "r", "owner": {"login": "o"}}}, "labels": [{"name": "bug"}]}))
    records = {
        "commit": [{"sha": "abcdef0123456", "author": {"login": "al"}, "commit": {"message": "Do\n\nmore", "committer": {"date": "2024-01-01T12:00:00Z"}}, "files": [{"filename": "a", "patch": "@@"}, {"filename": "bin"}]}],
        "check_run": [{"id": 1, "name": "build", "app": {"slug": "act"}, "conclusion": "success", "completed_at": "2024-01-01T13:00:00Z"}],
        "review_comment": [{"id": 2, "user": {"login": "bo"}, "path": "a", "original_line": 4, "body": "why", "created_at": "2024-01-01T14:00:00Z"}],
        "issue_comment": [{"id": 3, "user": {"login": "bo"}, "body": "ok", "created_at": "2024-01-01T16:00:00Z"}],
        "review": [{"id": 4, "user": {"login": "bo"}, "state": "APPROVED", "submitted_at": "2024-01-01T17:00:00Z"}, {"id": 5, "state": "PENDING"}],
    }
    for kind, rows in records.items():
        (d / f"{kind}s.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    pulls, found = captures.pull_request_records(spark, str(tmp_path))
    steps = derive.pull_request_steps(found)
    got = steps.orderBy("pos").collect()
    assert [r.step_id for r in got] == ["step-abcdef01", "step-ci-1", "step-rc-2", "step-ic-3", "step-rv-4"]
    assert [r.parents for r in got] == [[], ["step-abcdef01"], ["step-ci-1"], ["step-rc-2"], ["step-ic-3"]]
    assert list(got[2].change) == ["review://a#L4"] and list(got[0].change) == ["a"] and got[0].intent == "Do" and got[0].revision == "abcdef0123456"
    assert json.loads(got[1].change["ci://checks/build"].structural) == {"type": "ci.run", "conclusion": "success"}
    p = derive.pull_request_paths(pulls, steps).first()
    assert (p.base_uri, p.base_ref, p.head, p.labels) == ("github:o/r", "dev", "step-rv-4", ["bug"])
    assert [r.href for r in p.refs] == ["https://github.com/o/r/issues/3", "https://github.com/o/r/issues/5"]
    assert derive.pull_request_steps(found, comments=False, ci=False).count() == 1


def test_git_history(spark, tmp_path):
    f = lambda *x: "\x1f".join(x) + "\x1e\n"
    (tmp_path / "main").write_text(f("b" * 40, "a" * 40, "Alice", "alice@example.com", "86400", "fix the bug\n\nbody\n") + f("a" * 40, "", "Alice B", "none", "0", "start\n"))
    log = captures.git_log(spark, str(tmp_path / "main"))
    from pyspark.sql import functions as F

    files = spark.createDataFrame([("b" * 40, "main.rs", "@@")], "sha string, path string, patch string")
    steps = derive.commit_steps(log.withColumn("base", F.lit("a" * 40)).where("pos > 0"), files).collect()
    assert [(s.step_id, s.parents, s.actor, s.ts, s.intent) for s in steps] == [("step-bbbbbbbb", [], "human:alice", "1970-01-02T00:00:00Z", "fix the bug")]
    assert steps[0].change["main.rs"].raw == "@@"
    b = spark.createDataFrame([("r", "feat/x"), ("r", "main")], "repo string, name string")
    assert tuple(derive.graph_identity(b).first()) == ("r", "graph-feat-x-main", "feat/x, main")
    assert captures.default_branch(["develop", "master"]) == "master"


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    from pyspark.sql import functions as F

    L = F.lit
    assert one(X.title(L("é" * 12), 10)) == "é" * 10 + "..." and one(X.truncate(L("é" * 12), 10)) == "é" * 7 + "..."
    assert one(X.author_slug(L("Al Smith "), L("unknown"))) == "al-smith" and one(X.author_slug(L("A"), L("A.B@x"))) == "a-b"
    assert one(X.git_url(L("git@github.com:o/r.git.git"))) == "github:o/r" and one(X.git_url(L("https://example.com/o/r.git"))) == "https://example.com/o/r.git"
    pr = one(X.pull_request_url(L("github.com/o/r/pull/12#x")))
    assert (pr.owner, pr.repo, int(pr.number)) == ("o", "r", 12) and one(X.pull_request_url(L("https://github.com/o/r/issues/1"))) is None
    assert one(X.issue_refs(L("resolves #1 prefixes#7 Fixes  #2 fixes #7"))) == ["7", "2", "1"]
    assert one(X.next_link(L('<https://a?page=1>; rel="prev", <https://a?page=3>; rel="next"'))) == "https://a?page=3"
    assert one(X.time_of_day(L("2024-01-01T10:00:00.5ZZ"))) == "10:00:00.5" and one(X.time_of_day(L("none"))) is None
    assert one(X.actor_name(L("agent:a:b"))) == "a:b" and one(X.actor_label(L("agent:a:b"))) == "b"
    assert one(X.escape_html(L('<a & "b">'))) == "&lt;a &amp; &quot;b&quot;&gt;" and one(X.escape_dot(L('a"\\\n'))) == 'a\\"\\\\\\n'
    spec = one(X.branch_spec(L("main:HEAD~2:x")))
    assert (spec.name, spec.start) == ("main", "HEAD~2:x")
    assert one(X.tool_category(L("Grep"))) == "file_search" and one(X.tool_category(L("Zap"))) is None
    assert one(X.intent_label(L("x" * 41))) == "x" * 37 + "…" and one(X.role(L("USER"))) == "user"


def ops(spark, *rows):
    cols = ("op", "seq", "parent_seq", "content", "actor", "ts", "intent", "source")
    return spark.createDataFrame([("s", i, *(r.get(c) for c in cols)) for i, r in enumerate(rows)], track.OPERATION)


def test_track(spark):
    o = lambda op, seq=None, parent=None, content=None, **m: {"op": op, "seq": seq, "parent_seq": parent, "content": content} | m
    got = track.sessions(ops(spark, o("init", content="a\n", actor="human:me"), o("note", intent="early"), o("step", 1, 0, "a\nb\n"), o("step", 2, 1, "a\nb\n"), o("step", 1, 0, "zzz"), o("visit", 3, 1, "a\nb\n"), o("step", 4, 3, "a\nc\n", actor="agent:x"), o("step", 5, 0, "q\n"), o("step", 6, 99, "x"), o("annotate", intent="why", source="git:1"))).collect()
    steps = sorted((r.step_id, r.parents, r.actor, r.intent, r.head) for r in got if r.step_id)
    assert steps == [("step-001", [], "human:me", None, False), ("step-002", ["step-001"], "agent:x", None, False), ("step-003", [], "human:me", "why", True)]
    assert sorted(r.error for r in got if r.error) == ["no step to write to", "unknown parent sequence 99"]
    assert track.unified_diff("a\nb\n", "a\nc") == "@@ -1,2 +1,2 @@\n a\n-b\n+c\n\\ No newline at end of file\n"
    assert track.unified_diff("x", "x") is None
