import json
from pathlib import Path

from pyspark.sql import functions as F

from provmill.operators import dag, render
from provmill.sources import documents as D


def step(id, parents=(), actor="human:petra", ts="2026-01-29T10:00:00Z", change=None, **meta):
    s = {"step": {"id": id, "actor": actor, "timestamp": ts}, "change": change if change is not None else {"lib/gear.py": {"raw": "@@"}}}
    if parents:
        s["step"]["parents"] = list(parents)
    return s | ({"meta": meta} if meta else {})


PATH = {
    "path": {"id": "path-1", "head": "third", "base": {"uri": "github:acorn/lathe", "ref": "abcdef0123456", "commit": "x"}},
    "steps": [step("first", source={"type": "git", "revision": "0123456789"}), step("second", ["first"], "agent:model/1"), step("aside", ["first"], "tool:fmt", intent="x" * 50), step("third", ["second"], "ci:run", change={"a/b.rs": {"structural": {"type": "t", "n": 1}}, "c.rs": {"raw": ""}, "d": {}})],
    "meta": {"title": 'A "path"', "actors": {"human:petra": {"name": "Petra", "keys": [{"type": "gpg", "fingerprint": "F1"}]}}, "signatures": [{"signer": "human:petra", "key": "F1", "scope": "author", "sig": "s"}]},
}
GRAPH = {"graph": {"id": "g"}, "paths": [PATH, {"$ref": "https://x/y.json"}, {"path": {"id": "path-2", "head": "first", "base": {"uri": "github:acorn/lathe", "ref": "01234567ff"}}, "steps": [step("first")]}]}


def docs(spark, **by_uri):
    return spark.createDataFrame([(u, d if isinstance(d, str) else json.dumps(d)) for u, d in by_uri.items()], "uri string, raw string")


def test_validation(spark):
    got = {r.uri: r.message for r in D.validate(docs(spark, a={"Step": step("s")}, b={"Path": PATH}, c={"Graph": GRAPH}, d="no", e={"Step": step("s"), "Path": PATH}, f={"Other": 1}, g={"Step": {"step": {"id": "s", "actor": "a", "timestamp": "t"}}}, h={"Step": {"step": {"id": "s", "actor": "a", "timestamp": "t", "parents": None}, "change": {}}}, i={"Path": {"path": {"id": "p", "head": "h"}, "steps": [step("x"), {"step": {}}]}}, j="")).collect()}
    assert got["a"] == "Valid: Step (s)" and got["b"] == "Valid: Path (path-1, 4 steps)" and got["c"] == "Valid: Graph (g)"
    assert all(got[k].startswith("Invalid: ") for k in "defghij")
    assert D.rejects(docs(spark, d="no")).count() == 1


def test_steps_and_closure(spark):
    d = docs(spark, b={"Path": PATH}, c={"Graph": GRAPH})
    steps, paths = D.scoped(D.steps(d)), D.scoped(D.paths(d))
    inline = paths.where("ref_url is null")
    dead = {(r.path_id, r.step_id) for r in dag.dead_ends(steps, inline.select("path_id", "head")).collect()}
    assert dead == {("b#0#path-1", "aside"), ("c#0#path-1", "aside")}
    row = steps.where("uri = 'b' and step_id = 'third'").first()
    assert row.parents == ["second"] and row.change["c.rs"].raw == "" and json.loads(row.change["a/b.rs"].structural) == {"type": "t", "n": 1}
    assert steps.where("revision = '0123456789'").count() == 2
    assert {r.path_id for r in D.first_path_only(D.paths(d)).collect()} == {"path-1"}
    assert paths.where("ref_url is not null").first().ref_url == "https://x/y.json"


def test_merge_and_write(spark):
    d = docs(spark, a={"Step": step("s")}, b={"Path": PATH}, c={"Graph": GRAPH})
    row = D.merge(d, "All").first()
    made = json.loads(row.raw)["Graph"]
    assert row.graph_id == made["graph"]["id"] == "graph-merged-5" and made["meta"] == {"title": "All"}
    assert made["paths"][0]["path"] == {"id": "path-s", "head": "s"} and made["paths"][3] == {"$ref": "https://x/y.json"}
    assert D.validate(docs(spark, m=row.raw)).first().message == "Valid: Graph (graph-merged-5)"
    out = json.loads(D.to_json(D.steps(docs(spark, b={"Path": PATH}))).first().raw)
    assert [s["step"]["id"] for s in out] == ["first", "second", "aside", "third"] and "parents" not in out[0]["step"]
    assert out == [{k: v for k, v in s.items()} for s in PATH["steps"]]


def test_documents_are_written_as_they_were_read(spark):
    d = docs(spark, b={"Path": PATH}, c={"Path": {**PATH, "path": {"id": "bare", "head": "first"}, "meta": None, "steps": [step("first", refs=[{"rel": "fixes", "href": "x"}], intent="why")]}})
    made = {r.path_id: json.loads(r.raw)["Path"] for r in D.path_documents(D.paths(d), D.steps(d)).collect()}
    known = {k: v for k, v in PATH["path"].items() if k != "base"} | {"base": {k: v for k, v in PATH["path"]["base"].items() if k != "commit"}}
    assert made["path-1"] == PATH | {"path": known}
    assert made["bare"]["steps"] == [step("first", refs=[{"rel": "fixes", "href": "x"}], intent="why")] and made["bare"]["path"] == {"id": "bare", "head": "first"}
    assert json.loads(D.pretty('{"a":[1]}')) == {"a": [1]}


def test_documents_from_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"Path": PATH}, indent=1))
    read = D.read(spark, str(tmp_path / "*.json"))
    assert D.validate(read).first().message == "Valid: Path (path-1, 4 steps)" and read.first().uri.endswith("/a.json")
    assert D.validate(D.from_text(spark, ["[]"])).first().message.startswith("Invalid: ")


def test_drawings_by_kind(spark):
    d = docs(spark, a={"Step": step("only", ["gone"])}, b={"Path": PATH}, c={"Graph": GRAPH}, x="{")
    got = {r.uri: r.dot for r in render.drawings(d).collect()}
    assert set(got) == {"a", "b", "c"} and all(x.startswith("digraph provenance {\n") and x.endswith("}\n") for x in got.values())
    assert '  "gone" -> "only";' in got["a"] and "cluster_legend" in got["b"] and got["c"].count("subgraph cluster_") == 2


def test_first_match_and_its_head(spark):
    d = docs(spark, c={"Graph": GRAPH})
    ids = spark.createDataFrame([("c", "first"), ("c", "none")], "uri string, step_id string")
    assert [(r.step_id, r.path_pos) for r in D.first_match(D.steps(d), ids).collect()] == [("first", 0)]
    assert [tuple(r) for r in D.head_of_step(D.steps(d), D.paths(d), ids).collect()] == [("c", "first", "third")]


def test_steps_are_found_in_their_documents(spark):
    """As by first_match() and head_of_step(); the query stores no documents and deals neither them nor steps."""
    again = {"graph": {"id": "h"}, "paths": [{"$ref": "r", "steps": [step("first")]}, {"path": {"id": "p", "head": "u"}, "steps": [step("first", ["u"], "ci:a"), step("u"), step("first", actor="ci:b")]}, PATH]}
    d = docs(spark, c={"Graph": GRAPH}, h={"Graph": again}, s={"Step": step("alone")}, x="{")
    ids = spark.createDataFrame([("c", "first"), ("c", "none"), ("c", "third"), ("h", "first"), ("h", "first"), ("h", "third"), ("s", "alone"), ("x", "first"), ("h", None)], "uri string, step_id string")
    got = D.find_steps(d, ids)
    assert sorted(map(tuple, got.select("uri", "step_id", "head").collect())) == sorted(map(tuple, D.head_of_step(D.steps(d), D.paths(d), ids).collect()))
    own = ["uri", "step_id", "path_pos", "parents", "actor", "ts", "intent", "revision"]
    assert sorted(map(str, got.select(*own).collect())) == sorted(map(str, D.first_match(D.steps(d), ids).select(*own).collect()))
    assert [r.actor for r in got.where("uri = 'h' and step_id = 'first'").collect()] == ["ci:a"]
    from __spark_entry__ import queries

    plan = queries()["j_09_find_step"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Scan ExistingRDD" not in plan and not [x for x in plan.splitlines() if "Exchange" in x and ("raw" in x or "step_id" in x)]


def test_sessions(spark, tmp_path):
    from provmill.sources import sessions

    state = '{"file":"f","default_actor":"human:me","created_at":"now","version":1,"buffer_cache":{"0":"a"}}'
    d = docs(spark, b={"Path": PATH}, c={"Path": {"path": {"id": "bare", "head": "h"}, "steps": []}})
    saved = sessions.with_state(d, F.lit(state)).unionByName(docs(spark, x="{", y={"Path": PATH}))
    assert {(r.session_id, r.file, r.actor, r.n_steps, r.created_at) for r in sessions.listing(saved).collect()} == {("path-1", "f", "human:me", 4, "now"), ("bare", "f", "human:me", 0, "now")}
    out = {r.session_id: json.loads(r.raw) for r in sessions.export(saved).collect()}
    assert out["path-1"] == {"Path": PATH} and out["bare"] == {"Path": {"path": {"id": "bare", "head": "h"}, "steps": []}}
    closed, rest = sessions.close(saved, "bare")
    assert closed.count() == 1 and {r.uri for r in rest.collect()} == {"b", "x", "y"}
    sessions.save(saved.where("uri <> 'x'"), str(tmp_path / "saved"))
    assert sorted(r.uri for r in sessions.load(spark, str(tmp_path / "saved")).collect()) == ["bare", "path-1", "path-1"]
    (tmp_path / "track-1.json").write_text(saved.where("uri = 'b'").first().raw)
    (tmp_path / "track-2.json").write_text("{bad")
    (tmp_path / "other.json").write_text("{}")
    assert [r.session_id for r in sessions.listing(sessions.read(spark, str(tmp_path))).collect()] == ["path-1"]


def test_saved_sessions_take_little_of_the_disk(spark, tmp_path):
    """They are compressed and read again whole; the shuffles that made them are given up."""
    from provmill.sources import sessions

    whole = {"Path": PATH | {"steps": PATH["steps"] * 500}}
    raw = json.dumps(whole, separators=(",", ":"))
    shuffles = lambda: {f for p in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs() for f in Path(p.getPath()).rglob("shuffle_*.data")}
    before = shuffles()
    sessions.save(spark.range(20).select(F.lit(raw).alias("raw"), "id").repartition(3, "id"), str(tmp_path / "s"))
    assert shuffles() <= before
    files = [f for f in (tmp_path / "s").iterdir() if f.name.startswith("part-")]
    assert files and all(f.name.endswith(".txt.gz") for f in files) and sum(f.stat().st_size for f in files) < 20 * len(raw) / 10
    assert [(r.uri, r.raw == raw) for r in sessions.load(spark, str(tmp_path / "s")).collect()] == [("path-1", True)] * 20


def test_strict_findings_and_signatures(spark):
    d = docs(spark, b={"Path": PATH})
    found = {(r.step_id, r.finding) for r in D.strict_findings(d).collect()}
    assert found == {(None, "base key commit"), ("third", "change without raw or structural")}
    assert [(r.scope, r.defined) for r in D.signatures(d).collect()] == [("author", True)]
    assert D.missing_scopes(d, ("author", "reviewer")).first().missing == ["reviewer"]


def test_strict_rules_are_looked_at_in_a_documents_row(spark):
    """Every rule, without a shuffle; a document is parsed once."""
    odd = {"path": {"id": "o", "head": "gone", "base": {"uri": "u", "zip": 1}}, "steps": [step("a", ["x", "x"], actor="bad"), step("a", ["a", "y"], ts="no"), step("b", ["b", None]), step("c", change={"f": {}, "g": {"raw": None, "structural": None}}), step("a")]}
    graph = {"graph": {"id": "g"}, "paths": [{"path": {"id": "e", "head": "h"}, "steps": []}, {"$ref": "q", "steps": [step("hidden", ["u"])]}, {"path": {"id": "o", "head": "s"}, "steps": [step("s", ["a"])]}]}
    d = docs(spark, o={"Path": odd}, g={"Graph": graph}, s={"Step": step("alone")}, x="{")
    found = D.strict_findings(d)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson(raw") == 1 and "Exchange" not in plan
    of = lambda uri: sorted((r.path_id, r.step_id or "", r.finding) for r in found.where(F.col("uri") == uri).collect())
    lost, id_ = "parent is no step", "o#0#o"
    assert of("o") == sorted([(id_, "", "base key zip"), (id_, "gone", "head is no step"), (id_, "a", "actor"), (id_, "a", "timestamp"), (id_, "a", "step id not unique"), (id_, "a", lost), (id_, "a", lost), (id_, "a", lost), (id_, "b", lost), (id_, "c", "change without raw or structural")])
    assert of("g") == [("g#0#e", "", "path without base"), ("g#0#e", "h", "head is no step"), ("g#2#o", "", "path without base"), ("g#2#o", "s", lost)]
    assert of("s") == [("s#0#path-alone", "", "path without base")] and of("x") == []


def test_drawings(spark):
    d = docs(spark, b={"Path": PATH}, c={"Graph": GRAPH})
    steps, paths = D.scoped(D.steps(d)), D.scoped(D.paths(d))
    dot = render.joined(render.path_lines(paths.where("uri = 'b'"), steps.where("uri = 'b'"))).first().dot
    assert dot.startswith("digraph provenance {\n") and dot.endswith("}\n")
    assert '  label="A \\"path\\"";' in dot and "abcdef01</font>" in dot
    assert '"third" [label=<<b>third</b><br/><font point-size="10">run</font><br/><font point-size="8" color="#666666">3 files</font>>, fillcolor="#e2d5f1", style="rounded,filled,bold", penwidth=3];' in dot
    assert "<b>01234567</b>" in dot and 'style="rounded,filled,dashed"' in dot and "x" * 37 + "…" in dot
    assert '"first" -> "aside" [color="#cccccc", style=dashed];' in dot and '"__base__" -> "first";' in dot
    graph = render.joined(render.graph_lines(paths.where("uri = 'c'"), steps.where("uri = 'c'")), "graph_id").first().dot
    assert '<font point-size="9">https://x/y.json</font>>, shape=note' in graph and "subgraph cluster_2 {" in graph
    assert '"c#0#path-1/first" -> "c#2#path-2/first" [color="#333333", penwidth=2];' in graph
    nodes, edges = render.layout(paths.where("uri = 'b'"), steps.where("uri = 'b'"))
    assert {(r.step_id, r.kind) for r in nodes.collect()} == {("first", "step"), ("second", "step"), ("aside", "dead"), ("third", "head"), (None, "base")}
    assert edges.where("kind = 'on'").count() == 2 and [(r.source, r.target) for r in edges.where("kind = 'base'").collect()] == [("__BASE__", "first")]
    nodes, edges = render.layout(paths.where("uri = 'b'"), steps.where("uri = 'b'"), timestamps=True, files=True, dead=False)
    shown = {r.step_id: r.label.split("\n") for r in nodes.where("kind <> 'base'").collect()}
    assert "aside" not in shown and "aside" not in {r.target for r in edges.collect()}
    assert shown["third"][:2] == ["third", "run"] and len(shown["third"]) >= 6 and all(len(x) <= 33 for x in shown["third"])
    nodes, edges = render.layout(paths.where("uri = 'c'"), steps.where("uri = 'c'"), scope="uri")
    got = {(r.cluster, r.node_id, r.kind) for r in nodes.collect()}
    assert ("cluster_0", "c0/first", "step") in got and ("cluster_1", "c1/https://x/y.json", "ref") in got and ("cluster_2", "c2/first") in {x[:2] for x in got}
    assert all(r.source[:3] == r.target[:3] for r in edges.collect())


def test_documents_are_parsed_once(spark):
    """A filter on what parsing found doesn't repeat the parsing for each use of it."""
    d = docs(spark, b={"Path": PATH})
    for made in (D.steps(d), D.paths(d), D.validate(d), D.rejects(d), D.parse(d).where("error is null")):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parseJson(raw") == 1, plan


def test_documents_are_rewritten_in_their_row(spark):
    """The same texts as by way of paths and steps, but each document is parsed once and nothing is shuffled."""
    odd = {"path": {"id": 'q"\\/\u00e9\U0001f600\n', "head": "h", "base": None}, "steps": [step("s", change={"b": {"raw": None, "structural": None}, "a": {"structural": [1.50, {"z": 1, "a": None}]}, "\ue000": 3, "\U0001f600": {}}), {**step("t"), "meta": None, "more": 1}, step("u", change={}, refs=[])], "meta": None}
    bare = {"Step": step("bare", ["gone"])}
    owned = {"Step": step("own", actors={"human:petra": {"name": "Petra"}})}
    d = docs(spark, a=bare, b={"Path": PATH}, c={"Graph": GRAPH}, e={"Path": odd}, f=owned, g={"Path": {"path": {"id": "none", "head": "h"}, "steps": []}}, x="{")
    paths = D.scoped(D.paths(d).withColumn("id", F.col("path_id"))).where("ref_url is null")
    want = {r.path_id: r.raw for r in D.path_documents(paths, D.scoped(D.steps(d))).collect()}
    made = D.rewritten(d)
    assert {f"{r.uri}#{r.path_pos}#{r.path_id}": r.raw for r in made.collect()} == want and len(want) == 7
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson(raw") == 1 and "Exchange" not in plan


def test_cluster_fills_need_paths_alone(spark):
    """The same lines as in the whole drawing, but no step is looked at: each document is parsed once, nothing is stored or searched."""
    from __spark_entry__ import queries

    d = docs(spark, c={"Graph": GRAPH})
    paths, steps = D.scoped(D.paths(d)), D.scoped(D.steps(d))
    whole = render.graph_lines(paths, steps).where("section % 10 = 0 and ord < 7 and line not like '%$ref%' and section between 10 and 999999999")
    assert sorted(map(tuple, render.cluster_lines(paths).collect())) == sorted(map(tuple, whole.collect())) and whole.count() == 14
    plan = queries()["snk_06_cluster_fills"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(raw") == 1 and "MapInArrow" not in plan and "ExistingRDD" not in plan and "LogicalRDD" not in plan, plan


def test_graphs_are_drawn_in_the_rows_of_their_paths(spark):
    """The same lines as by way of tables of paths and steps; no step is shuffled or joined but for bases."""
    from __spark_entry__ import queries

    odd = {"graph": {"id": "o"}, "paths": [{"path": {"id": 'q"\\', "head": "gone"}, "steps": [step("s", ["u", "none"], change={}), step("u", ["s"], change={"a/b": {}, "c": {}, "d/e": {"raw": ""}}, intent="y" * 50)]}, {"path": {"id": "empty", "head": "h", "base": {"uri": "u", "ref": "zzz"}}, "steps": []}, {"$ref": "https://x/<y>", "steps": [step("hidden")]}]}
    d = docs(spark, a={"Graph": GRAPH}, b={"Graph": odd}, c={"Graph": {"graph": {"id": "none"}, "paths": []}}, x="{")
    by_uri = lambda rows: D.scoped(rows).withColumn("graph_id", F.col("uri"))
    for options in ({}, {"timestamps": True, "dead": False}, {"files": False}):
        want = render.graph_lines(by_uri(D.paths(d)), by_uri(D.steps(d)), **options)
        got = render.graph_row_lines(by_uri(D.path_rows(d)), **options)
        assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    same = {"graph": {"id": "s"}, "paths": [{"path": {"id": "p", "head": "a"}, "steps": [step("r"), step("a", ["r"]), step("a", ["r"])]}]}
    links = [r.line for r in render.graph_row_lines(by_uri(D.path_rows(docs(spark, s={"Graph": same})))).where("section = 1000000000").collect()]
    assert links == ['  "s#0#p/r" -> "s#0#p/a" [color="#333333", penwidth=2];'] * 2  # a link for each step, not for each pair of steps of one id
    rows = D.path_rows(docs(spark, a={"Step": step("only", ["gone"])}, b={"Path": PATH}))
    assert [(r.uri, r.path_id, r.head, r.title, r.based, len(r.steps)) for r in rows.orderBy("uri").collect()] == [("a", "path-only", "only", None, False, 1), ("b", "path-1", "third", 'A "path"', True, 4)]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson(raw") == 1 and "Exchange" not in plan
    plan = queries()["snk_06_graph_drawings"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "LogicalRDD" not in plan and plan.count("ArrowEvalPython") == 1, plan


def test_states_are_put_where_there_is_one(spark):
    """Documents without a state stay as they were, in the same pass; what sessions hold is told in their rows."""
    from provmill.sources import sessions

    d = docs(spark, a={"Path": PATH}, b={"Path": PATH}, x="{", y="{")
    state = F.when(F.col("uri").isin("a", "x"), F.lit('{"file":"f"}'))
    made = {r.uri: r.raw for r in sessions.with_state(d, state).collect()}
    assert set(made) == {"a", "b", "y"} and made["b"] == json.dumps({"Path": PATH}) and made["y"] == "{" and json.loads(made["a"])["Path"]["meta"]["track"] == {"file": "f"}
    facts = D.path_facts(docs(spark, a=made["a"], g={"Graph": GRAPH}, s={"Step": step("s")}))
    assert sorted((r.uri, r.path_id, r.n_steps, r.title, r.has_state) for r in facts.collect()) == [("a", "path-1", 4, 'A "path"', True), ("g", "path-1", 4, 'A "path"', False), ("g", "path-2", 1, None, False), ("s", "path-s", 1, None, False)]
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson(raw") == 1 and "Exchange" not in plan
