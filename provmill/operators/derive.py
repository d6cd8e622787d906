"""Steps derived from other records: pull requests, commits, conversations.

Results have path_id, pos, step_id, parents, actor, ts, change, intent, revision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provmill.functions import text as X

#: A record without a time (fixed value).
NO_TIME = "1970-01-01T00:00:00Z"
CHANGE = "map<string,struct<raw:string,structural:string>>"


def _g(path: str) -> Column:
    return F.get_json_object("raw", path)


def _one(artifact: Column, raw: Column | None, structural: Column | None) -> Column:
    none = F.lit(None).cast("string")
    return F.create_map(artifact, F.struct((none if raw is None else raw).alias("raw"), (none if structural is None else structural).alias("structural"))).cast(CHANGE)


def _structural(kind: str, **fields: Column) -> Column:
    return F.to_json(F.struct(F.lit(kind).alias("type"), *(c.alias(n) for n, c in fields.items())))


def _step(kind_ord: int, step_id: Column, actor: Column, ts: Column, change: Column, intent: Column | None = None, revision: Column | None = None) -> list[Column]:
    none = F.lit(None).cast("string")
    return [F.col("path_id"), F.lit(kind_ord).alias("kind_ord"), F.col("ord"), step_id.alias("step_id"), actor.alias("actor"), F.coalesce(ts, F.lit(NO_TIME)).alias("ts"), change.alias("change"), (none if intent is None else intent).alias("intent"), (none if revision is None else revision).alias("revision")]


def _person(path: str) -> Column:
    return F.concat(F.lit("human:"), F.coalesce(_g(path), F.lit("unknown")))


def _id(prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.coalesce(_g("$.id"), F.lit("0")))


def commit_records(r: DataFrame) -> DataFrame:
    sha = F.coalesce(_g("$.sha"), F.lit(""))
    files = F.from_json(F.coalesce(_g("$.files"), F.lit("[]")), "array<struct<filename:string,patch:string>>")
    patched = F.filter(files, lambda f: f["patch"].isNotNull())
    # of repeated names the last counts
    last = F.filter(patched, lambda f, i: ~F.exists(F.slice(patched, i + 2, F.size(patched)), lambda g: g["filename"] == f["filename"]))
    change = F.map_from_entries(F.transform(last, lambda f: F.struct(F.coalesce(f["filename"], F.lit("unknown")), F.struct(f["patch"].alias("raw"), F.lit(None).cast("string").alias("structural"))))).cast(CHANGE)
    intent = F.nullif(F.get(F.split(F.coalesce(_g("$.commit.message"), F.lit("")), "\r?\n"), 0), F.lit(""))
    return r.select(*_step(0, F.concat(F.lit("step-"), X.prefix(sha, 8)), _person("$.author.login"), _g("$.commit.committer.date"), change, intent, F.when(intent.isNotNull(), sha)))


def review_comments(r: DataFrame) -> DataFrame:
    at = F.concat(F.lit("review://"), F.coalesce(_g("$.path"), F.lit("unknown")), F.lit("#L"), F.coalesce(_g("$.line"), _g("$.original_line"), F.lit("0")))
    return r.select(*_step(1, _id("step-rc-"), _person("$.user.login"), _g("$.created_at"), _one(at, None, _structural("review.comment", body=F.coalesce(_g("$.body"), F.lit(""))))))


def issue_comments(r: DataFrame) -> DataFrame:
    return r.select(*_step(2, _id("step-ic-"), _person("$.user.login"), _g("$.created_at"), _one(F.lit("review://conversation"), F.coalesce(_g("$.body"), F.lit("")), None)))


def reviews(r: DataFrame) -> DataFrame:
    state = F.coalesce(_g("$.state"), F.lit(""))
    done = r.where((state != "") & (state != "PENDING"))
    return done.select(*_step(3, _id("step-rv-"), _person("$.user.login"), _g("$.submitted_at"), _one(F.lit("review://decision"), F.nullif(_g("$.body"), F.lit("")), _structural("review.decision", state=state))))


def check_runs(r: DataFrame) -> DataFrame:
    at = F.concat(F.lit("ci://checks/"), F.coalesce(_g("$.name"), F.lit("unknown")))
    return r.select(*_step(4, _id("step-ci-"), F.concat(F.lit("ci:"), F.coalesce(_g("$.app.slug"), F.lit("ci"))), F.coalesce(_g("$.completed_at"), _g("$.started_at")), _one(at, None, _structural("ci.run", conclusion=F.coalesce(_g("$.conclusion"), F.lit("unknown"))))))


def pull_request_steps(records: DataFrame, comments: bool = True, ci: bool = True) -> DataFrame:
    """One trunk a pull request, in order of time.

    ``records``: path_id, kind (commit, review_comment, issue_comment, review,
    check_run), ord, raw (JSON).  At equal times the kinds come in this order,
    records of a kind in theirs.
    """
    of = lambda k: records.where(F.col("kind") == k)
    out = commit_records(of("commit"))
    if comments:
        out = out.unionByName(review_comments(of("review_comment"))).unionByName(issue_comments(of("issue_comment"))).unionByName(reviews(of("review")))
    if ci:
        out = out.unionByName(check_runs(of("check_run")))
    order = Window.partitionBy("path_id").orderBy("ts", "kind_ord", "ord", "step_id")
    return out.withColumn("pos", F.row_number().over(order) - 1).withColumn("parents", F.array_compact(F.array(F.lag("step_id").over(order)))).drop("kind_ord", "ord")


def pull_request_paths(pulls: DataFrame, steps: DataFrame) -> DataFrame:
    """path_id, base_uri, base_ref, head, title, intent, refs, labels.  ``pulls``: path_id, raw (JSON)."""
    owner, repo = F.coalesce(_g("$.base.repo.owner.login"), F.lit("unknown")), F.coalesce(_g("$.base.repo.name"), F.lit("unknown"))
    refs = F.transform(X.issue_refs(_g("$.body")), lambda n: F.struct(F.lit("fixes").alias("rel"), F.concat(F.lit("https://github.com/"), owner, F.lit("/"), repo, F.lit("/issues/"), n).alias("href")))
    labels = F.filter(F.transform(F.from_json(F.coalesce(_g("$.labels"), F.lit("[]")), "array<struct<name:string>>"), lambda x: x["name"]), lambda x: x.isNotNull())
    last = steps.groupBy("path_id").agg(F.max_by("step_id", "pos").alias("head"))
    return pulls.join(last, "path_id", "left").select(
        "path_id", F.concat(F.lit("github:"), owner, F.lit("/"), repo).alias("base_uri"), F.coalesce(_g("$.base.ref"), F.lit("main")).alias("base_ref"), F.coalesce("head", F.concat(F.lit("pr-"), F.coalesce(_g("$.number"), F.lit("0")))).alias("head"), _g("$.title").alias("title"), F.nullif(_g("$.body"), F.lit("")).alias("intent"), refs.alias("refs"), F.when(F.size(labels) > 0, labels).alias("labels"),
    )


def commit_steps(commits: DataFrame, files: DataFrame) -> DataFrame:
    """Steps of git histories.

    ``commits``: path_id, pos, sha, parents, author_name, author_email, time
    (seconds), message, base (the sha below the first step, or null); ``files``:
    sha, path, patch.
    """
    short = lambda s: F.concat(F.lit("step-"), X.prefix(s, 8))
    change = files.groupBy("sha").agg(F.map_from_entries(F.collect_list(F.struct("path", F.struct(F.col("patch").alias("raw"), F.lit(None).cast("string").alias("structural"))))).alias("change"))
    intent = F.nullif(F.get(F.split(F.btrim("message"), "\r?\n"), 0), F.lit(""))
    parents = F.transform(F.filter("parents", lambda p: F.coalesce(p != F.col("base"), F.lit(True))), short)
    return commits.join(change, "sha", "left").select(
        "path_id", "pos", short(F.col("sha")).alias("step_id"), parents.alias("parents"), F.concat(F.lit("human:"), X.author_slug("author_name", "author_email")).alias("actor"), X.utc_text("time").alias("ts"), F.coalesce("change", F.create_map().cast(CHANGE)).alias("change"), intent.alias("intent"), F.col("sha").alias("revision"),
    )


def graph_identity(branches: DataFrame) -> DataFrame:
    """(repo, graph_id, title) of branches: repo, name."""
    names = F.transform(F.array_sort(F.collect_list("name")), lambda x: x.cast("string"))
    named = branches.groupBy("repo").agg(names.alias("n"))
    few = F.concat(F.lit("graph-"), F.array_join(F.transform("n", lambda x: F.replace(x, F.lit("/"), F.lit("-"))), "-"))
    many = F.concat(F.lit("graph-"), F.size("n").cast("string"), F.lit("-branches"))
    return named.select("repo", F.when(F.size("n") <= 3, few).otherwise(many).alias("graph_id"), F.array_join("n", ", ").alias("title"))


#: Characters of text kept in a conversation step.
KEPT_TEXT = 2000


def conversation_steps(entries: DataFrame, thinking: bool = False) -> DataFrame:
    """Steps of conversations: path_id, pos and what sources.logs.entries() has.

    Entries without a message, of the system, or with neither text nor tool use
    are left out.  The main line is chained; a side chain's step hangs off its
    parent entry, which may be no step.
    """
    said = entries.where("has_message and role <> 'system' and uuid <> ''")
    part_text = lambda p: F.when(p["type"] == "text", p["text"]).when((p["type"] == "thinking") & F.lit(thinking), F.concat(F.lit("[thinking] "), p["thinking"]))
    text = F.array_join(F.filter(F.transform("parts", part_text), lambda x: x.isNotNull() & (x != "")), "\n\n")
    names = F.transform("tool_uses", lambda u: u["name"])
    e = said.withColumn("__text", text).where((F.col("__text") != "") | (F.size("tool_uses") > 0)).withColumn("step_id", F.concat(F.lit("step-"), X.prefix("uuid", 8)))
    before = Window.partitionBy("path_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    trunk = F.last(F.when(~F.col("is_sidechain"), F.col("step_id")), ignorenulls=True).over(before)
    parent = F.when(F.col("is_sidechain"), F.concat(F.lit("step-"), X.prefix("parent_uuid", 8))).otherwise(trunk)
    actor = F.when(F.col("role") == "user", "human:user").otherwise(F.concat(F.lit("agent:"), F.coalesce("model", F.lit("assistant"))))
    none = F.lit(None).cast("string")
    append = F.to_json(F.struct(F.lit("conversation.append").alias("type"), "role", F.when(F.col("__text") != "", X.truncate("__text", KEPT_TEXT)).alias("text"), F.when(F.size("tool_uses") > 0, names).alias("tool_uses")))
    convo = F.struct(F.concat(F.lit("convo://"), "path_id").alias("key"), F.struct(none.alias("raw"), append.alias("structural")).alias("value"))
    path_of = lambda u: F.when(u["name"].isin("Write", "Edit"), F.get_json_object(u["input"], "$.file_path"))
    touched = F.array_distinct(F.filter(F.transform("tool_uses", path_of), lambda f: f.isNotNull()))
    files = F.transform(touched, lambda f: F.struct(f.alias("key"), F.struct(none.alias("raw"), none.alias("structural")).alias("value")))
    change = F.map_from_entries(F.concat(F.array(convo), files)).cast(CHANGE)
    return e.select("path_id", "pos", "step_id", F.array_compact(F.array(parent)).alias("parents"), actor.alias("actor"), "ts", change.alias("change"), none.alias("intent"), none.alias("revision"), "is_sidechain")


def conversation_heads(steps: DataFrame) -> DataFrame:
    """(path_id, head): the last step of the main line, or ``empty``."""
    return steps.groupBy("path_id").agg(F.coalesce(F.max_by("step_id", F.when(~F.col("is_sidechain"), F.col("pos"))), F.lit("empty")).alias("head"))


def actor_definitions(steps: DataFrame) -> DataFrame:
    """(path_id, actor, name): each actor once, as first seen."""
    return steps.groupBy("path_id", "actor").agg(F.min("pos").alias("first_pos")).select("path_id", "actor", X.actor_name("actor").alias("name"))
