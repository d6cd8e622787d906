"""Queries on documents, logs and captured records made from the star-schema tables.

The records are written as JSON text first, so each query goes through the
reader that it is about.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provmill.functions import signing
from provmill.operators import assembly, derive, render, track
from provmill.plans import adapters as A
from provmill.plans.adapters import CLOSURE_SQL, EVENT_STEPS_SQL, ORDER_STEPS_SQL, table
from provmill.plans.queries import query
from provmill.sources import documents as D
from provmill.sources import logs

_STEPS = f"WITH {EVENT_STEPS_SQL}"
_ORDERS = f"WITH {ORDER_STEPS_SQL}"


#: What a step of an order is made of.
_LINE = ("pos", "revision", "supplier", "ts")


def order_paths(steps: DataFrame, *by: str) -> DataFrame:
    """(``by``, lines): the steps of order_steps() gathered in order, as they are, before text is made of them."""
    return steps.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*_LINE))).alias("lines"))


def path_object(path_id: Column, lines: Column) -> Column:
    """An order's path of its gathered lines, which are a chain of steps."""
    name = lambda pos: F.concat_ws("-", path_id, pos.cast("string"))
    none = F.array().cast("array<string>")
    one = lambda x, i: F.struct(
        F.struct(name(x["pos"]).alias("id"), F.when(i > 0, F.array(name(F.get(lines, i - 1)["pos"]))).otherwise(none).alias("parents"), F.concat(F.lit("agent:"), x["supplier"]).alias("actor"), x["ts"].alias("timestamp")).alias("step"),
        F.create_map(F.concat(F.lit("part/"), x["revision"]), F.struct(F.lit("@@").alias("raw"), F.struct(x["pos"].alias("n")).alias("structural"))).alias("change"),
        F.struct(F.struct(F.lit("git").alias("type"), x["revision"].alias("revision")).alias("source")).alias("meta"),
    )
    return F.struct(F.struct(path_id.alias("id"), name(F.element_at(lines, -1)["pos"]).alias("head")).alias("path"), F.transform(lines, one).alias("steps"))


def order_documents(spark, d) -> DataFrame:
    """A Path document for each order; its line items are a chain of steps."""
    whole = order_paths(A.order_steps(spark, d), "path_id")
    return whole.select(F.col("path_id").alias("uri"), F.to_json(F.struct(path_object(F.col("path_id"), F.col("lines")).alias("Path"))).alias("raw"))


def log_lines(spark, d, chained: bool = False, tasks: bool = False, extras: bool = False) -> DataFrame:
    """Events as log lines: a user's events are a segment.

    Purchases are tool calls, clicks results of the user's last purchase (text
    where there is none), errors entries without a message.  ``chained``: the
    first two lines of a user from 7 on whose number three doesn't divide carry
    the session of the user with a number less by seven.  ``tasks``: all calls
    delegate.  ``extras``: every line but every fifth of a user has two fields that no column is for.
    """
    steps = A.event_steps(spark, d)
    before = Window.partitionBy("path_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    call = F.last(F.when(F.col("event_type") == "purchase", F.col("step_id")), ignorenulls=True).over(before)
    e = steps.withColumn("call", call)
    text = F.concat(F.lit('"'), "artifact", F.lit('"'))
    use = F.concat(F.lit('[{"type":"tool_use","id":"call-'), "step_id", F.lit('","name":"'), F.lit("Task") if tasks else F.when(F.col("artifact").endswith("0"), "Edit").otherwise("Bash"), F.lit('","input":{"file_path":"'), "artifact", F.lit('","prompt":"do '), "artifact", F.lit('"}}]'))
    result = F.concat(F.lit('[{"type":"tool_result","tool_use_id":"call-'), "call", F.lit('","content":"'), "step_id", F.lit('","is_error":'), F.endswith("artifact", F.lit("3")).cast("string"), F.lit("}]"))
    content = F.when(F.col("event_type") == "purchase", use).when((F.col("event_type") == "click") & F.col("call").isNotNull(), result).otherwise(text)
    role = F.when(F.col("event_type").isin("purchase", "signup"), "assistant").otherwise("user")
    message = F.when(F.col("event_type") != "error", F.concat(F.lit(',"message":{"role":"'), role, F.lit('","content":'), content, F.lit(',"usage":{"input_tokens":'), F.col("pos").cast("string"), F.lit("}}"))).otherwise("")
    u = F.col("path_id").cast("long")
    session = F.when((u >= 7) & (u % 3 != 0) & (F.col("pos") <= 2), (u - 7).cast("string")).otherwise(F.col("path_id")) if chained else F.col("path_id")
    line = F.concat(F.lit('{"type":"'), F.when(F.col("event_type") == "error", "progress").otherwise(role), F.lit('","uuid":"'), "step_id", F.lit('","timestamp":"'), "ts", F.lit('","sessionId":"'), session, F.lit('"'), message, *([F.when(F.col("pos") % 5 != 0, F.concat(F.lit(',"subtype":"'), "artifact", F.lit('","hook":{"n":'), F.col("pos").cast("string"), F.lit("}"))).otherwise("")] if extras else []), F.lit("}"))
    return e.select(F.lit("events").alias("project"), F.col("path_id").alias("segment"), F.concat(F.lit("/events/"), "path_id", F.lit(".jsonl")).alias("file"), (F.col("pos") - 1).alias("line_no"), line.alias("line"))


def _entries(spark, d) -> DataFrame:
    return logs.positions(logs.entries(log_lines(spark, d))).withColumn("path_id", F.col("segment"))


#: The same entries straight from the events.
_LOG_SQL = f"""{_STEPS}, calls AS (
  SELECT *, last_value(CASE WHEN event_type = 'purchase' THEN step_id END IGNORE NULLS) OVER (PARTITION BY path_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS call FROM steps),
answers AS (SELECT path_id, call, min(pos) AS at, arg_min(step_id, pos) AS answer FROM calls WHERE event_type = 'click' AND call IS NOT NULL GROUP BY ALL)"""


@query(f"{_ORDERS} SELECT path_id, step_id, CAST(pos - 1 AS BIGINT) AS pos, 'agent:' || supplier AS actor, ts, 'part/' || revision AS artifact, revision, CASE WHEN pos > 1 THEN path_id || '-' || CAST(pos - 1 AS VARCHAR) ELSE '' END AS parents FROM osteps")
def src_01_parse_documents(spark, d):
    s = D.steps(order_documents(spark, d))
    return s.select("path_id", "step_id", F.col("pos").cast("long").alias("pos"), "actor", "ts", F.element_at(F.map_keys("change"), 1).alias("artifact"), "revision", F.array_join("parents", ",").alias("parents"))


@query(f"{_ORDERS} SELECT path_id AS uri, 'Valid: Path (' || path_id || ', ' || CAST(count(*) AS VARCHAR) || ' steps)' AS message FROM osteps GROUP BY path_id")
def snk_13_validate(spark, d):
    return D.validate(order_documents(spark, d)).select("uri", "message")


@query("SELECT o_orderkey AS uri, CASE o_orderkey % 4 WHEN 0 THEN 'not JSON' WHEN 1 THEN 'not exactly one of Step, Path, Graph' WHEN 2 THEN 'path.head' ELSE 'step.change' END AS error FROM orders")
def src_01_rejects(spark, d):
    k = F.col("o_orderkey")
    raw = F.when(k % 4 == 0, '{"Path":').when(k % 4 == 1, '{"Path":{},"Step":{}}').when(k % 4 == 2, '{"Path":{"path":{"id":"p"},"steps":[]}}').otherwise('{"Step":{"step":{"id":"s","actor":"a","timestamp":"t"}}}')
    return D.rejects(table(spark, d, "orders").select(k.alias("uri"), raw.alias("raw")))


@query(f"{_ORDERS} SELECT path_id AS uri, 'path without base' AS finding, count(*) AS n FROM (SELECT DISTINCT path_id FROM osteps) GROUP BY ALL")
def src_01_strict_findings(spark, d):
    return D.strict_findings(order_documents(spark, d)).groupBy("uri", "finding").agg(F.count("*").alias("n"))


@query(f"{_ORDERS} SELECT path_id, '[' || string_agg('\"' || step_id || '\"', ',' ORDER BY pos) || ']' AS ids FROM osteps GROUP BY path_id")
def snk_02_steps_as_json(spark, d):
    raw = D.to_json(D.steps(order_documents(spark, d)))
    return raw.select("path_id", F.get_json_object("raw", "$[*].step.id").alias("ids")).withColumn("ids", F.when(F.col("ids").startswith("["), F.col("ids")).otherwise(F.concat(F.lit("["), "ids", F.lit("]"))))


@query(
    f"""WITH RECURSIVE {EVENT_STEPS_SQL}, {CLOSURE_SQL}
    SELECT e.path_id, '  "' || e.parent || '" -> "' || e.child || '" [' || CASE WHEN c.step_id IS NOT NULL AND p.step_id IS NOT NULL THEN 'color="#333333", penwidth=2' ELSE 'color="#cccccc", style=dashed' END || '];' AS line
    FROM edges e JOIN heads h USING (path_id) LEFT JOIN closure c ON c.path_id = e.path_id AND c.step_id = e.child LEFT JOIN closure p ON p.path_id = e.path_id AND p.step_id = e.parent"""
)
def snk_05_dot_lines(spark, d):
    steps = A.event_steps(spark, d)
    none = F.lit(None).cast("string")
    paths = A.event_heads(steps).select("path_id", "head", none.alias("base_uri"), none.alias("base_ref"), none.alias("title"))
    full = steps.withColumn("revision", none).withColumn("intent", none).withColumn("change", F.create_map("artifact", F.struct(none.alias("raw"), none.alias("structural"))))
    return render.path_lines(paths, full.join(paths.select("path_id"), "path_id")).where("section = 5").select("path_id", "line")


@query(f"{_LOG_SQL} SELECT path_id AS segment, step_id AS uuid, CASE WHEN event_type <> 'error' THEN CASE WHEN event_type IN ('purchase', 'signup') THEN 'assistant' ELSE 'user' END END AS role, CASE WHEN event_type = 'error' OR event_type = 'purchase' OR (event_type = 'click' AND call IS NOT NULL) THEN '' ELSE artifact END AS text FROM calls")
def src_08_log_entries(spark, d):
    return logs.entries(log_lines(spark, d)).select("segment", "uuid", "role", "text")


@query(f"{_STEPS} SELECT path_id AS segment, count(*) FILTER (WHERE event_type <> 'error') AS message_count, min(ts) AS started_at, max(ts) AS last_activity FROM steps GROUP BY path_id")
def src_09_metadata(spark, d):
    m = logs.metadata(log_lines(spark, d))
    return m.select("segment", "message_count", *(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c) for c in ("started_at", "last_activity")))


@query(f"{_STEPS} SELECT DISTINCT path_id AS segment, path_id AS session_id FROM steps WHERE pos <= 10")
def src_12_first_session_id(spark, d):
    return logs.first_session_ids(log_lines(spark, d)).select("segment", "session_id")


@query(f"{_LOG_SQL} SELECT path_id, step_id AS turn_id FROM calls WHERE event_type <> 'error' AND NOT (event_type = 'click' AND call IS NOT NULL)")
def asm_01_turns(spark, d):
    return assembly.turns(_entries(spark, d)).select("path_id", "turn_id")


@query(f"{_LOG_SQL} SELECT c.path_id, 'call-' || c.step_id AS id, CASE WHEN suffix(artifact, '0') THEN 'file_write' ELSE 'shell' END AS category, a.answer AS result FROM calls c LEFT JOIN answers a ON a.path_id = c.path_id AND a.call = c.step_id WHERE event_type = 'purchase'")
def asm_02_log_tool_results(spark, d):
    return assembly.calls_of(_entries(spark, d)).select("path_id", "id", "category", F.col("result.content").alias("result"))


@query(f"{_LOG_SQL}, f AS (SELECT path_id, artifact AS file, min(pos) AS p FROM calls WHERE event_type = 'purchase' AND suffix(artifact, '0') GROUP BY ALL) SELECT path_id, string_agg(file, ',' ORDER BY p) AS files FROM f GROUP BY path_id")
def agg_04_view_files(spark, d):
    v = assembly.views(assembly.turns(_entries(spark, d)))
    return v.where(F.size("files_changed") > 0).select("path_id", F.array_join("files_changed", ",").alias("files"))


@query(f"{_LOG_SQL} SELECT path_id, CAST(sum(pos) AS BIGINT) AS input_tokens FROM calls WHERE event_type <> 'error' AND NOT (event_type = 'click' AND call IS NOT NULL) GROUP BY path_id")
def agg_03_view_usage(spark, d):
    return assembly.views(assembly.turns(_entries(spark, d))).select("path_id", "input_tokens")


@query(f"{_LOG_SQL} SELECT path_id, step_id AS uuid FROM calls WHERE event_type = 'purchase' AND NOT suffix(artifact, '0')")
def flt_11_uses_tool(spark, d):
    return assembly.uses_tool(_entries(spark, d), "Bash").select("path_id", "uuid")


@query(f"{_LOG_SQL} SELECT path_id, step_id AS uuid FROM calls WHERE event_type = 'click' AND call IS NOT NULL")
def flt_20_result_only(spark, d):
    return _entries(spark, d).where(assembly.is_result_only()).select("path_id", "uuid")


@query(f"{_LOG_SQL} SELECT path_id, step_id AS uuid FROM calls WHERE event_type <> 'error' AND event_type <> 'purchase' AND contains(CASE WHEN event_type = 'click' AND call IS NOT NULL THEN step_id ELSE artifact END, '7')")
def flt_12_log_text(spark, d):
    return assembly.with_text(_entries(spark, d), "7").select("path_id", "uuid")


@query(
    f"""{_LOG_SQL}, k AS (SELECT *, left(step_id, 8) AS short FROM calls WHERE event_type <> 'error' AND NOT (event_type = 'click' AND call IS NOT NULL))
    SELECT path_id, 'step-' || short AS step_id, 'step-' || lag(short) OVER (PARTITION BY path_id ORDER BY pos) AS parent, CASE WHEN event_type IN ('purchase', 'signup') THEN 'agent:assistant' ELSE 'human:user' END AS actor FROM k"""
)
def drv_03_conversation_steps(spark, d):
    return derive.conversation_steps(_entries(spark, d)).select("path_id", "step_id", F.get("parents", 0).alias("parent"), "actor")


@query(
    f"""{_ORDERS}, r AS (SELECT path_id, pos, ts, CASE pos % 3 WHEN 0 THEN 'step-' || left(revision || '-' || path_id, 8) WHEN 1 THEN 'step-rc-' || CAST(pos AS VARCHAR) ELSE 'step-ci-' || CAST(pos AS VARCHAR) END AS step_id, CASE pos % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 4 END AS k FROM osteps)
    SELECT path_id, step_id, ts, lag(step_id) OVER (PARTITION BY path_id ORDER BY ts, k, pos) AS parent FROM r"""
)
def drv_02_pull_request(spark, d):
    s = A.order_steps(spark, d)
    commit = F.to_json(F.struct(F.concat_ws("-", "revision", "path_id").alias("sha"), F.struct(F.struct(F.col("ts").alias("date")).alias("committer"), F.lit("m").alias("message")).alias("commit")))
    comment = F.to_json(F.struct(F.col("pos").alias("id"), F.col("ts").alias("created_at"), F.lit("b").alias("body")))
    check = F.to_json(F.struct(F.col("pos").alias("id"), F.col("ts").alias("completed_at")))
    kind = F.when(F.col("pos") % 3 == 0, "commit").when(F.col("pos") % 3 == 1, "review_comment").otherwise("check_run")
    raw = F.when(F.col("pos") % 3 == 0, commit).when(F.col("pos") % 3 == 1, comment).otherwise(check)
    records = s.select("path_id", kind.alias("kind"), F.col("pos").alias("ord"), raw.alias("raw"))
    return derive.pull_request_steps(records).select("path_id", "step_id", "ts", F.get("parents", 0).alias("parent"))


@query("SELECT CAST(user_id AS VARCHAR) AS path_id, 'step-' || left(CAST(event_id AS VARCHAR) || 'abcdefgh', 8) AS step_id, 'human:user-' || CAST(user_id AS VARCHAR) AS actor, strftime(make_timestamp(event_id * 60000000), '%Y-%m-%dT%H:%M:%SZ') AS ts, event_type AS intent FROM events")
def prj_07_commit_steps(spark, d):
    e = table(spark, d, "events")
    commits = e.select(
        F.col("user_id").cast("string").alias("path_id"), F.col("event_id").alias("pos"), F.concat(F.col("event_id").cast("string"), F.lit("abcdefgh")).alias("sha"), F.array().cast("array<string>").alias("parents"), F.lit("x").alias("author_name"), F.concat(F.lit("User."), F.col("user_id").cast("string"), F.lit("@example.com")).alias("author_email"),
        (F.col("event_id") * 60).alias("time"), F.concat(F.lit(" "), "event_type", F.lit("\n\nmore ")).alias("message"), F.lit(None).cast("string").alias("base"),
    )
    files = e.select(F.concat(F.col("event_id").cast("string"), F.lit("abcdefgh")).alias("sha"), F.lit("f").alias("path"), F.lit("@@").alias("patch"))
    return derive.commit_steps(commits, files).select("path_id", "step_id", "actor", "ts", "intent")


@query("SELECT event_id, sha256('{\"a\":\"' || event_type || '\",\"k\":' || json_extract_string(props, '$.k') || ',\"z\":[1,true,null]}') AS digest FROM events")
def fn_24_jcs_sha(spark, d):
    raw = F.concat(F.lit('{ "z" : [1.0, true,null], "k":'), F.get_json_object("props", "$.k"), F.lit('.0, "a":"'), "event_type", F.lit('"}'))
    return table(spark, d, "events").select("event_id", signing.payload_digest(raw).alias("digest"))


@query(
    f"""{_STEPS}, w AS (SELECT *, lag(artifact) OVER (PARTITION BY path_id ORDER BY pos) AS prev FROM steps),
    n AS (SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY pos) AS k, count(*) OVER (PARTITION BY path_id) AS m FROM w WHERE pos > 1 AND event_type <> 'error' AND artifact <> prev)
    SELECT path_id AS session, 'step-' || lpad(CAST(k AS VARCHAR), CAST(greatest(3, length(CAST(k AS VARCHAR))) AS INTEGER), '0') AS step_id, CASE WHEN k > 1 THEN 'step-' || lpad(CAST(k - 1 AS VARCHAR), CAST(greatest(3, length(CAST(k - 1 AS VARCHAR))) AS INTEGER), '0') ELSE '' END AS parents, actor,
      '@@ -1 +1 @@' || chr(10) || '-' || prev || chr(10) || '+' || artifact || chr(10) AS diff, k = m AS head FROM n"""
)
def str_08_track_fold(spark, d):
    """Each user's events as buffer states: an error undoes to the state before, any other event adds a line."""
    steps = A.event_steps(spark, d)
    n = F.col("pos").cast("long")
    ops = steps.select(F.col("path_id").alias("session"), n.alias("n"), F.when(F.col("pos") == 1, "init").when(F.col("event_type") == "error", "visit").otherwise("step").alias("op"), (n - 1).alias("seq"), (n - 2).alias("parent_seq"), F.concat("artifact", F.lit("\n")).alias("content"), "actor", "ts", F.lit(None).cast("string").alias("intent"), F.lit(None).cast("string").alias("source"))
    return track.sessions(ops).where("error is null").select("session", "step_id", F.array_join("parents", ",").alias("parents"), "actor", "diff", "head")
