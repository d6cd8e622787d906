"""Registered queries on the star-schema tables, each with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provmill.functions import table_functions
from provmill.functions import text as X
from provmill.operators import assembly, dag, derive, render
from provmill.operators import conversations as C
from provmill.operators import steps as S
from provmill.plans import adapters as A
from provmill.plans.adapters import CLOSURE_SQL, EVENT_STEPS_SQL, ORDER_STEPS_SQL, TURNS_SQL, table
from provmill.sources import logs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _events(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    steps = A.event_steps(spark, d)
    return steps, A.event_heads(steps)


_CLOSED = f"WITH RECURSIVE {EVENT_STEPS_SQL}, {CLOSURE_SQL}"
_STEPS = f"WITH {EVENT_STEPS_SQL}"
_TURNS = f"WITH {TURNS_SQL}"
_ORDERS = f"WITH {ORDER_STEPS_SQL}"


# closures


@query(f"{_CLOSED} SELECT s.path_id, s.step_id, s.actor FROM steps s JOIN closure USING (path_id, step_id)")
def dag_01_ancestors(spark, d):
    steps, heads = _events(spark, d)
    return dag.ancestors(steps, heads).select("path_id", "step_id", "actor")


@query(f"{_CLOSED} SELECT DISTINCT path_id, step_id FROM closure")
def dag_01_ancestors_in_sql(spark, d):
    steps, heads = _events(spark, d)
    table_functions.register(spark)
    return spark.sql(
        "SELECT path_id, step_id FROM ancestors(TABLE(SELECT path_id, step_id, parents, pos, head FROM {steps} LEFT JOIN {heads} USING (path_id)) PARTITION BY path_id ORDER BY pos)",
        steps=steps,
        heads=heads.select("path_id", "head"),
    )


@query(f"{_CLOSED} SELECT s.path_id, s.step_id, s.actor, s.ts FROM steps s JOIN heads h USING (path_id) WHERE NOT EXISTS (SELECT 1 FROM closure c WHERE c.path_id = s.path_id AND c.step_id = s.step_id)")
def dag_02_dead_ends(spark, d):
    steps, heads = _events(spark, d)
    return dag.dead_ends(steps, heads).select("path_id", "step_id", "actor", "ts")


@query(f"{_STEPS} SELECT path_id, count(*) AS n_steps FROM steps WHERE path_id NOT IN (SELECT path_id FROM heads) GROUP BY path_id")
def dag_03_headless(spark, d):
    return dag.headless(*_events(spark, d))


@query(f"{_STEPS} SELECT path_id, count(*) AS n_steps FROM steps GROUP BY path_id HAVING count(*) FILTER (WHERE event_type = 'signup' AND artifact = 'k/7') = 0")
def dag_03_headless_of_signups(spark, d):
    """A path's head is its last sign-up on one artifact; most have none."""
    steps = A.event_steps(spark, d)
    return dag.headless(steps, steps.where("event_type = 'signup' and artifact = 'k/7'").groupBy("path_id").agg(F.max_by("step_id", "pos").alias("head")))


@query(
    f"""WITH RECURSIVE {EVENT_STEPS_SQL}, asked AS (SELECT path_id, arg_max(step_id, pos) AS head FROM steps WHERE actor = 'tool:monitor' GROUP BY path_id),
    closure AS (SELECT path_id, head AS step_id FROM asked UNION SELECT c.path_id, e.parent FROM closure c JOIN edges e ON e.path_id = c.path_id AND e.child = c.step_id)
    SELECT s.path_id, s.step_id, s.pos FROM steps s JOIN closure USING (path_id, step_id)"""
)
def dag_04_ancestors_of_step(spark, d):
    steps = A.event_steps(spark, d)
    asked = steps.where("actor = 'tool:monitor'").groupBy("path_id").agg(F.max_by("step_id", "pos").alias("head"))
    return dag.ancestors(steps, asked).select("path_id", "step_id", F.col("pos").cast("long").alias("pos"))


@query(f"{_CLOSED} SELECT e.path_id, e.child, e.parent, c.step_id IS NOT NULL AND p.step_id IS NOT NULL AS active FROM edges e LEFT JOIN closure c ON c.path_id = e.path_id AND c.step_id = e.child LEFT JOIN closure p ON p.path_id = e.path_id AND p.step_id = e.parent")
def dag_06_active_edges(spark, d):
    return dag.active_edges(*_events(spark, d)).select("path_id", "child", "parent", "active")


@query(f"{_STEPS} SELECT path_id, step_id FROM steps WHERE parent1 IS NULL AND parent2 IS NULL")
def dag_07_roots(spark, d):
    return dag.roots(A.event_steps(spark, d)).select("path_id", "step_id")


@query(f"{_STEPS} SELECT s.path_id, s.step_id, CAST((parent1 IS NOT NULL)::INT + (parent2 IS NOT NULL)::INT AS BIGINT) AS n_parents, count(e.child) AS n_children FROM steps s LEFT JOIN edges e ON e.path_id = s.path_id AND e.parent = s.step_id GROUP BY ALL")
def dag_08_fork_merge_degree(spark, d):
    return dag.degrees(A.event_steps(spark, d))


@query(f"{_STEPS} SELECT path_id, arg_min(event_type, CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 ELSE 4 END) AS first_kind FROM steps WHERE event_type <> 'error' GROUP BY path_id")
def dag_11_by_priority(spark, d):
    return S.by_priority(A.event_steps(spark, d).where("event_type <> 'error'"), "path_id", "event_type", ("purchase", "signup", "click"), other=True).withColumnRenamed("event_type", "first_kind")


@query(f"{_STEPS} SELECT e.path_id, e.parent AS step_id, e.child FROM edges e")
def j_08_children(spark, d):
    return dag.children(A.event_steps(spark, d))


@query(f"{_STEPS} SELECT e.path_id, e.child, e.parent, p.actor AS parent_actor FROM edges e JOIN steps p ON p.path_id = e.path_id AND p.step_id = e.parent")
def j_01_parent_step(spark, d):
    steps = A.event_steps(spark, d)
    return S.parent_steps(steps, dag.edges(steps), "actor").select("path_id", "child", "parent", "parent_actor")


# filters


@query(f"{_STEPS} SELECT path_id, step_id, actor FROM steps WHERE starts_with(actor, 'human:u1')")
def flt_01_actor_prefix(spark, d):
    return S.by_actor(A.event_steps(spark, d), "human:u1").select("path_id", "step_id", "actor")


@query(f"{_STEPS} SELECT path_id, step_id FROM steps WHERE artifact = 'k/7'")
def flt_02_artifact(spark, d):
    return S.by_artifact(A.event_steps(spark, d), "k/7").select("path_id", "step_id")


@query(f"{_STEPS} SELECT path_id, step_id, ts FROM steps WHERE ts BETWEEN '2024-01-05T00:00:00Z' AND '2024-01-09T12:00:00Z'")
def flt_03_time_range(spark, d):
    return S.by_time(A.event_steps(spark, d), "2024-01-05T00:00:00Z", "2024-01-09T12:00:00Z").select("path_id", "step_id", "ts")


@query(f"{_STEPS} SELECT path_id, step_id FROM steps WHERE starts_with(actor, 'human:') AND artifact = 'k/7' AND ts BETWEEN '2024-01-05T00:00:00Z' AND '9999-12-31T23:59:59Z'")
def flt_04_conjunction(spark, d):
    return S.where_unique(A.event_steps(spark, d), actor="human:", artifact="k/7", after="2024-01-05T00:00:00Z").select("path_id", "step_id")


@query(rf"""{_CLOSED} SELECT s.path_id, s.step_id, s.artifact FROM steps s JOIN heads h USING (path_id) WHERE regexp_matches(artifact, '^k/1[^/]*$') AND NOT EXISTS (SELECT 1 FROM closure c WHERE c.path_id = s.path_id AND c.step_id = s.step_id)""")
def flt_05_dead_end_glob(spark, d):
    return S.by_artifact_glob(dag.dead_ends(*_events(spark, d)), "k/1*").select("path_id", "step_id", "artifact")


@query(f"{_STEPS} SELECT path_id, step_id, actor FROM steps WHERE split_part(actor, ':', 1) NOT IN ('tool', 'ci')")
def flt_06_blame_noise(spark, d):
    return S.blame(A.event_steps(spark, d), ("tool", "ci")).select("path_id", "step_id", "actor")


@query(f"{_TURNS} SELECT path_id, turn_id FROM turns WHERE role = 'assistant'")
def flt_08_by_role(spark, d):
    return C.by_role(A.turns(spark, d), "assistant").select("path_id", "turn_id")


@query("SELECT event_id, event_type FROM events WHERE event_type = 'purchase'")
def flt_09_by_type(spark, d):
    return logs.by_type(table(spark, d, "events").withColumn("type", F.col("event_type")), "purchase").select("event_id", "event_type")


@query("SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-04 00:00:00'")
def flt_10_instants(spark, d):
    return logs.between(table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp")), "2024-01-03 00:00:00", "2024-01-04 00:00:00").select("event_id")


def _history(spark, d):
    """Events as lines of a history; a user is a project."""
    ms = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) div 1000")
    return table(spark, d, "events").select("event_id", "event_type", F.col("props").alias("display"), ms.alias("timestamp"), F.col("user_id").cast("string").alias("project"), F.col("event_type").alias("session_id"))


@query(f"{_TURNS} SELECT path_id, turn_id FROM turns WHERE contains(lower(text), 'tion the')")
def flt_12_contains_text(spark, d):
    return C.contains_text(A.turns(spark, d), "TION the").select("path_id", "turn_id")


@query("SELECT event_id FROM events WHERE user_id = 7")
def flt_14_by_project(spark, d):
    return logs.history_of(_history(spark, d), project="7").select("event_id")


@query("SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events WHERE epoch_us(ts) // 1000 BETWEEN 1704240000000 AND 1704326400000")
def flt_15_history_range(spark, d):
    return logs.history_of(_history(spark, d), start=1704240000000, end=1704326400000).select("event_id", F.col("timestamp").alias("ms"))


@query("SELECT event_id, event_type FROM events WHERE contains(lower(props), '\"k\": 1')")
def flt_16_history_text(spark, d):
    return logs.history_of(_history(spark, d), search='"K": 1').select("event_id", "event_type")


@query(f"{_TURNS} SELECT path_id, turn_id, role FROM turns WHERE path_id IN (SELECT path_id FROM turns WHERE contains(lower(text), 'tion the'))")
def flt_19_conversations_with_text(spark, d):
    return C.conversations_with_text(A.turns(spark, d), "tion the").select("path_id", "turn_id", "role")


# aggregates


@query(f"{_STEPS} SELECT DISTINCT path_id, artifact FROM steps")
def agg_01_artifacts(spark, d):
    return S.artifacts(A.event_steps(spark, d))


@query(f"{_STEPS} SELECT DISTINCT path_id, actor FROM steps")
def agg_02_actors(spark, d):
    return S.actors(A.event_steps(spark, d))


@query(
    """SELECT CAST(conv_id AS VARCHAR) AS path_id, CAST(sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END) FILTER (WHERE role <> 'system') AS BIGINT) AS input_tokens,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) FILTER (WHERE role <> 'system') AS BIGINT) AS output_tokens,
    CAST(sum(CASE WHEN role = 'assistant' AND turn > 3 THEN turn END) AS BIGINT) AS cache_read_tokens FROM conversations GROUP BY conv_id"""
)
def agg_03_usage(spark, d):
    n = F.char_length("text").cast("long")
    usage = F.when(
        F.col("role") != "system",
        F.struct(F.when(F.col("role") == "user", n).alias("input_tokens"), F.when(F.col("role") == "assistant", n).alias("output_tokens"), F.when((F.col("role") == "assistant") & (F.col("pos") > 3), F.col("pos")).alias("cache_read_tokens"), F.lit(None).cast("long").alias("cache_write_tokens")),
    )
    return C.usage(A.turns(spark, d).withColumn("usage", usage)).drop("cache_write_tokens")


@query(
    f"""{_STEPS}, first AS (SELECT path_id, artifact AS file, min(pos) AS p FROM steps WHERE event_type = 'click' GROUP BY ALL)
    SELECT path_id, file, row_number() OVER (PARTITION BY path_id ORDER BY p) AS ord FROM first"""
)
def agg_04_files_first_touch(spark, d):
    calls = A.event_steps(spark, d).where("event_type = 'click'").select("path_id", "pos", F.lit(0).alias("call_pos"), F.col("artifact").alias("file"))
    return C.first_touch(calls).withColumn("ord", F.col("ord").cast("long"))


@query("SELECT CAST(conv_id AS VARCHAR) AS path_id, count(text) AS message_count FROM conversations GROUP BY conv_id")
def agg_05_message_count(spark, d):
    return A.turns(spark, d).groupBy("path_id").agg(F.count("text").alias("message_count"))


@query("SELECT CAST(user_id AS VARCHAR) AS path_id, strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ') AS started_at, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS last_activity, arg_min(event_type, (ts, event_id)) FILTER (WHERE event_type <> 'error') AS first_kind FROM events GROUP BY user_id")
def agg_06_bounds(spark, d):
    rows = table(spark, d, "events").withColumn("path_id", F.col("user_id").cast("string"))
    first = F.min_by("event_type", F.when(F.col("event_type") != "error", F.struct("ts", "event_id")))
    return rows.groupBy("path_id").agg(A.iso(F.min("ts")).alias("started_at"), A.iso(F.max("ts")).alias("last_activity"), first.alias("first_kind"))


@query("SELECT CAST(user_id AS VARCHAR) AS path_id, epoch_us(max(ts)) - epoch_us(min(ts)) AS micros FROM events GROUP BY user_id")
def agg_07_duration(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("path_id"), F.col("ts").alias("at"))
    return C.bounds(rows).select("path_id", F.expr("timestampdiff(MICROSECOND, started_at, last_activity)").alias("micros"))


@query(f"""{_TURNS}, f AS (SELECT path_id, arg_min(text, pos) AS t FROM turns WHERE role = 'user' AND text <> '' GROUP BY path_id)
    SELECT path_id, CASE WHEN length(t) > 40 THEN left(t, 40) || '...' ELSE t END AS title FROM f""")
def agg_08_title(spark, d):
    return C.titles(A.turns(spark, d), 40)


@query(
    """WITH m AS (SELECT user_id % 50 AS chain, user_id, count(*) AS n, min(ts) AS a, max(ts) AS b FROM events GROUP BY ALL)
    SELECT CAST(chain AS VARCHAR) AS head, CAST(sum(n) AS BIGINT) AS message_count, strftime(min(a), '%Y-%m-%dT%H:%M:%SZ') AS started_at, strftime(max(b), '%Y-%m-%dT%H:%M:%SZ') AS last_activity, min(user_id) AS first_segment FROM m GROUP BY chain"""
)
def agg_09_chain_metadata(spark, d):
    """A user's events are a segment, which continues that of the user with a number less by fifty."""
    none = F.lit(None).cast("string")
    metadata = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("message_count"), F.min("ts").alias("started_at"), F.max("ts").alias("last_activity")).withColumns({"project": none, "segment": F.col("user_id").cast("string")})
    first = metadata.where("user_id >= 50").select("project", "segment", (F.col("user_id") - 50).cast("string").alias("session_id"))
    m = assembly.chain_metadata(metadata, first)
    return m.select("head", "message_count", A.iso("started_at").alias("started_at"), A.iso("last_activity").alias("last_activity"), F.col("first_segment").cast("long").alias("first_segment"))


@query(f"{_STEPS} SELECT actor, arg_min(path_id, (CAST(path_id AS BIGINT), pos)) AS path_id, arg_min(step_id, (CAST(path_id AS BIGINT), pos)) AS step_id FROM steps GROUP BY actor")
def agg_12_first_definition(spark, d):
    defs = A.event_steps(spark, d).select("actor", F.struct(F.col("path_id").cast("long"), "pos").alias("at"), "path_id", "step_id")
    return S.first_definitions(defs, "actor", "at")


@query(f"{_STEPS} SELECT path_id, count(*) AS n_steps, max(pos) AS last_pos FROM steps GROUP BY path_id")
def agg_13_session_summary(spark, d):
    return C.summaries(A.event_steps(spark, d))


@query("""SELECT c_custkey AS graph, CASE WHEN count(*) <= 3 THEN 'graph-' || string_agg(CAST(o_orderkey AS VARCHAR), '-' ORDER BY o_orderkey) ELSE 'graph-' || CAST(count(*) AS VARCHAR) || '-branches' END AS graph_id
    FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def agg_15_graph_id(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    known = orders.join(table(spark, d, "customer").select("c_custkey"), "c_custkey").select(F.col("c_custkey").alias("repo"), F.col("o_orderkey").alias("name"))
    return derive.graph_identity(known).select(F.col("repo").alias("graph"), "graph_id")


@query(f"{_STEPS} SELECT path_id, count(DISTINCT artifact) AS seen_count, arg_max(step_id, pos) AS last_id FROM steps GROUP BY path_id")
def agg_16_seen_and_last(spark, d):
    return C.seen_and_last(A.event_steps(spark, d), "artifact", "step_id")


# windows


@query(f"{_STEPS} SELECT path_id, step_id, lag(step_id) OVER (PARTITION BY path_id ORDER BY ts, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END, pos) AS parent FROM steps")
def w_01_trunk_chain(spark, d):
    kind = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).otherwise(2)
    return C.chained(A.event_steps(spark, d), ["ts", kind, "pos"]).select("path_id", "step_id", "parent")


@query(f"{_STEPS} SELECT path_id, step_id, parent1 AS parent FROM steps")
def w_02_sidechain_parents(spark, d):
    rows = A.event_steps(spark, d).drop("parents").withColumn("is_sidechain", F.col("event_type") == "error")
    return C.main_line(rows).select("path_id", "step_id", "parent")


@query(f"{_TURNS}, m AS (SELECT path_id, min(pos) AS at FROM turns WHERE turn_id = path_id || '-2' GROUP BY path_id) SELECT t.path_id, t.turn_id FROM turns t LEFT JOIN m USING (path_id) WHERE t.pos > coalesce(m.at, -1)")
def w_03_turns_since(spark, d):
    turns = A.turns(spark, d)
    marks = turns.select("path_id", F.concat("path_id", F.lit("-2")).alias("turn_id")).distinct()
    return C.since(turns, marks).select("path_id", "turn_id")


@query(f"{_STEPS} SELECT path_id, step_id, 'step-' || lpad(CAST(row_number() OVER (PARTITION BY path_id ORDER BY pos) AS VARCHAR), 3, '0') AS label FROM steps WHERE event_type <> 'error'")
def w_04_step_counter(spark, d):
    return C.step_labels(A.event_steps(spark, d).where("event_type <> 'error'"))


@query(f"{_STEPS} SELECT path_id, step_id, artifact FROM steps QUALIFY row_number() OVER (PARTITION BY path_id, artifact ORDER BY pos) = 1")
def w_05_dedup_first(spark, d):
    return C.first_seen(A.event_steps(spark, d), ["path_id", "artifact"], ["pos"]).select("path_id", "step_id", "artifact")


@query("SELECT o_custkey AS graph, o_orderkey AS path, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) % 6 AS colour FROM orders")
def w_06_cluster_colour(spark, d):
    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return table(spark, d, "orders").select(F.col("o_custkey").alias("graph"), F.col("o_orderkey").alias("path"), render.cluster_number(pos).cast("long").alias("colour"))


# order


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 25")
def srt_01_recent(spark, d):
    return C.recent(table(spark, d, "events"), 25, "ts", "event_id").select("event_id", "event_type")


@query("SELECT user_id, row_number() OVER (ORDER BY max(ts) DESC, user_id) AS place FROM events GROUP BY user_id ORDER BY place LIMIT 100")
def srt_02_by_last_activity(spark, d):
    latest = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    return C.latest_first(latest, "last", "user_id", 100).select("user_id", "place")  # a top-100 report


@query("SELECT user_id FROM events GROUP BY user_id ORDER BY max(ts) DESC, user_id LIMIT 1")
def srt_03_most_recent(spark, d):
    return C.recent(table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last")), 1, "last", "user_id").select("user_id")


@query("SELECT p_brand AS name, count(*) AS n FROM part GROUP BY 1 ORDER BY 1")
def srt_04_by_name(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("n")).orderBy("name")


@query(f"{_TURNS} SELECT path_id, arg_min(turn_id, pos) AS first_id FROM turns WHERE pos < 10 AND text <> '' GROUP BY path_id")
def srt_06_first_lines(spark, d):
    return A.turns(spark, d).where("pos < 10 and text <> ''").groupBy("path_id").agg(F.min_by("turn_id", "pos").alias("first_id"))


# set operations


@query("WITH p AS (SELECT 'order-' || CAST(o_orderkey AS VARCHAR) AS path_id FROM orders UNION ALL SELECT 'user-' || CAST(user_id AS VARCHAR) FROM (SELECT DISTINCT user_id FROM events)) SELECT path_id, 'graph-merged-' || CAST(count(*) OVER () AS VARCHAR) AS graph_id FROM p")
def set_01_merge(spark, d):
    orders = table(spark, d, "orders").select(F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("path_id"))
    users = table(spark, d, "events").select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("path_id")).distinct()
    return S.merge(orders.unionByName(users)).select("path_id", "graph_id")


@query("SELECT CAST(user_id AS VARCHAR) AS actor FROM events UNION SELECT CAST(o_custkey AS VARCHAR) FROM orders")
def set_02_union_distinct(spark, d):
    return S.distinct_union(table(spark, d, "events").select(F.col("user_id").cast("string").alias("actor")), table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("actor")))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_03_except(spark, d):
    return S.without(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query(f"{_STEPS} SELECT path_id, artifact FROM steps EXCEPT SELECT path_id, artifact FROM steps WHERE event_type = 'view'")
def set_03_never_viewed(spark, d):
    steps = A.event_steps(spark, d)
    return S.without(S.artifacts(steps), steps.where("event_type = 'view'").select("path_id", "artifact"), "path_id", "artifact")


@query(f"{_STEPS} SELECT path_id, step_id FROM steps WHERE starts_with(actor, 'ci:') AND artifact IN ('k/3', 'k/4')")
def set_04_intersect(spark, d):
    steps = A.event_steps(spark, d)
    some = S.by_artifact(steps, "k/3").unionByName(S.by_artifact(steps, "k/4"))
    return S.by_actor(steps, "ci:").join(some.select("path_id", "step_id"), ["path_id", "step_id"], "left_semi").select("path_id", "step_id")


@query(f"{_ORDERS} SELECT graph_id, path_id, count(*) AS n_steps, arg_max(step_id, pos) AS head FROM osteps GROUP BY ALL")
def set_05_graph_of_paths(spark, d):
    return S.heads_of(A.order_steps(spark, d), "graph_id", "path_id")


# joins


@query(
    f"""{_ORDERS}, p AS (SELECT graph_id, path_id, lag(r) OVER (PARTITION BY graph_id ORDER BY path_id) AS base_ref, row_number() OVER (PARTITION BY graph_id ORDER BY path_id) AS path_pos FROM (SELECT graph_id, path_id, max(revision) AS r FROM osteps GROUP BY ALL)),
    x AS (SELECT s.graph_id, s.revision, arg_max(s.step_id, (p.path_pos, s.pos)) AS step_id FROM osteps s JOIN p USING (graph_id, path_id) GROUP BY ALL)
    SELECT p.graph_id, p.path_id, x.step_id AS base_step FROM p LEFT JOIN x ON x.graph_id = p.graph_id AND x.revision = p.base_ref"""
)
def j_05_base_revision(spark, d):
    steps = dag.cut(A.order_steps(spark, d))
    order = Window.partitionBy("graph_id").orderBy("path_id")
    paths = steps.groupBy("graph_id", "path_id").agg(F.max("revision").alias("r")).select("graph_id", "path_id", F.lag("r").over(order).alias("base_ref"), F.row_number().over(order).alias("path_pos"))
    return S.base_steps(paths, steps.join(paths.select("graph_id", "path_id", "path_pos"), ["graph_id", "path_id"]))


@query(f"{_ORDERS} SELECT o.path_id, o.step_id, coalesce(s_name, o.supplier) AS actor_name FROM osteps o LEFT JOIN supplier ON CAST(s_suppkey AS VARCHAR) = o.supplier")
def j_07_resolve_actor(spark, d):
    steps = A.order_steps(spark, d).withColumn("actor", F.concat(F.lit("agent:"), F.col("supplier")))
    defs = table(spark, d, "supplier").select(F.concat(F.lit("agent:"), F.col("s_suppkey").cast("string")).alias("actor"), F.col("s_name").alias("name"))
    return S.resolve_actors(steps, defs).select("path_id", "step_id", "actor_name")


@query("SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def j_07_label_lookup(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")


@query(f"{_ORDERS}, s AS (SELECT revision, count(DISTINCT path_id) AS n_paths, min(path_id) AS first_path FROM osteps GROUP BY revision HAVING count(DISTINCT path_id) > 1) SELECT o.revision, o.path_id, o.step_id, s.n_paths, s.first_path FROM osteps o JOIN s USING (revision)")
def j_13_same_change(spark, d):
    return S.same_change(A.order_steps(spark, d)).select("revision", "path_id", "step_id", "n_paths", "first_path")


@query(
    f"""{_ORDERS}, c AS (SELECT a.path_id AS a_path, a.step_id AS a_step, b.path_id AS b_path, b.step_id AS b_step FROM osteps a JOIN osteps b ON a.revision = b.revision AND a.path_id < b.path_id AND a.graph_id = b.graph_id),
    w AS (SELECT a_path AS path_id, a_step AS step_id, b_path || '/' || b_step AS h FROM c UNION SELECT b_path, b_step, a_path || '/' || a_step FROM c)
    SELECT path_id, step_id, string_agg('same-change=path:' || h, ',' ORDER BY h) AS refs FROM w GROUP BY ALL"""
)
def drv_04_correlate_refs(spark, d):
    # within one customer's graph
    steps = dag.cut(A.order_steps(spark, d).select("path_id", "step_id", F.concat_ws("@", "revision", "graph_id").alias("revision")))
    hubs = dag.cut(S.correlate(steps))
    out = S.add_refs(S.add_refs(steps, hubs), hubs)  # twice: nothing changes
    return out.where(F.size("refs") > 0).select("path_id", "step_id", F.array_join(F.transform(F.array_sort("refs"), lambda r: F.concat(r["rel"], F.lit("="), r["href"])), ",").alias("refs"))


@query(f"{_ORDERS}, c AS (SELECT revision, graph_id, path_id, step_id, count(*) OVER (PARTITION BY revision, graph_id) AS n, count(*) OVER (PARTITION BY revision, graph_id, path_id) AS own FROM osteps) SELECT revision || '@' || graph_id AS revision, path_id, step_id FROM c WHERE n > own")
def drv_04_hubs(spark, d):
    """The steps that others go with, a row each."""
    return S.correlate(A.order_steps(spark, d).withColumn("revision", F.concat_ws("@", "revision", "graph_id")))


@query(f"{_ORDERS} SELECT a.path_id AS a_path, a.step_id AS a_step, b.path_id AS b_path, b.step_id AS b_step FROM osteps a JOIN osteps b ON a.revision = b.revision AND a.path_id < b.path_id AND a.graph_id = b.graph_id")
def drv_04_pairs(spark, d):
    return S.pairs(S.correlate(A.order_steps(spark, d).withColumn("revision", F.concat_ws("@", "revision", "graph_id")))).drop("revision")


@query(f"{_STEPS} SELECT path_id, step_id, actor, pos FROM steps")
def prj_04_step_index(spark, d):
    return dag.step_index(A.event_steps(spark, d)).select("path_id", "step_id", "actor", F.col("pos").cast("long").alias("pos"))


@query(
    f"""{_STEPS} SELECT c.path_id, c.step_id AS call_id, min(r.pos) AS result_pos FROM steps c LEFT JOIN steps r ON r.path_id = c.path_id AND r.artifact = c.artifact AND r.event_type = 'click' AND r.pos > c.pos
    WHERE c.event_type = 'purchase' GROUP BY ALL"""
)
def asm_02_tool_results(spark, d):
    """Each purchase is a call; the next click on the same artifact is its result."""
    steps = A.event_steps(spark, d)
    # one scan in reverse order: the nearest later click
    after = Window.partitionBy("path_id", "artifact").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    found = steps.withColumn("result_pos", F.first(F.when(F.col("event_type") == "click", F.col("pos")), ignorenulls=True).over(after))
    return found.where("event_type = 'purchase'").select("path_id", F.col("step_id").alias("call_id"), F.col("result_pos").cast("long").alias("result_pos"))


@query(
    """WITH RECURSIVE links AS (SELECT DISTINCT user_id AS succ, user_id - 7 AS pred FROM events WHERE user_id >= 7 AND user_id % 3 <> 0),
    chain AS (SELECT DISTINCT user_id AS head, user_id AS segment, 0 AS ord FROM events WHERE user_id NOT IN (SELECT succ FROM links)
      UNION ALL SELECT c.head, l.succ, c.ord + 1 FROM chain c JOIN links l ON l.pred = c.segment)
    SELECT CAST(head AS VARCHAR) AS head, CAST(segment AS VARCHAR) AS segment, CAST(ord AS BIGINT) AS ord FROM chain"""
)
def chn_02_session_chain(spark, d):
    from provmill.operators.chains import chains

    segments = table(spark, d, "events").select("user_id").distinct()
    links = segments.where("user_id >= 7 and user_id % 3 <> 0").select((F.col("user_id") - 7).cast("string").alias("pred"), F.col("user_id").cast("string").alias("succ"))
    return chains(segments.select(F.col("user_id").cast("string").alias("segment")), links).select("head", "segment", F.col("ord").cast("long").alias("ord"))


# text functions


def _documents(spark, d, **columns) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", *(c.alias(n) for n, c in columns.items()))


@query("SELECT doc_id, left(text, 8) AS short FROM documents")
def fn_01_prefix(spark, d):
    return _documents(spark, d, short=X.prefix("text", 8))


@query("SELECT doc_id, CASE WHEN length(text) > 60 THEN left(text, 60) || '...' ELSE text END AS title FROM documents")
def fn_02_title_trunc(spark, d):
    return _documents(spark, d, title=X.title("text", 60))


@query("SELECT doc_id, CASE WHEN length(text) > 2000 THEN left(text, 1997) || '...' ELSE text END AS text FROM documents")
def fn_03_trunc(spark, d):
    return _documents(spark, d, text=X.truncate("text", 2000))


@query("SELECT doc_id, CASE WHEN length(text) > 40 THEN left(text, 37) || '…' ELSE text END AS intent FROM documents")
def fn_04_intent_label(spark, d):
    return _documents(spark, d, intent=X.intent_label("text"))


@query(r"SELECT c_custkey, trim(regexp_replace(lower(c_name || ' #'), '[^\p{L}\p{N}]', '-', 'g'), '-') AS by_name, regexp_replace(lower(c_name), '[^\p{L}\p{N}]', '-', 'g') AS by_email FROM customer")
def fn_06_slug(spark, d):
    name = F.concat("c_name", F.lit(" #"))
    return table(spark, d, "customer").select("c_custkey", X.author_slug(name, F.lit("unknown")).alias("by_name"), X.author_slug(name, F.concat("c_name", F.lit("@example.com"))).alias("by_email"))


@query(
    r"""SELECT page_id, 'github:' || split_part(url, '/', 3) || '/r' AS ssh, 'gitlab:' || split_part(url, '/', 3) || '/r' AS https, url || '.git' AS other FROM pages"""
)
def fn_07_url(spark, d):
    host = F.split_part("url", F.lit("/"), F.lit(3))
    return table(spark, d, "pages").select(
        "page_id", X.git_url(F.concat(F.lit("git@github.com:"), host, F.lit("/r.git.git"))).alias("ssh"), X.git_url(F.concat(F.lit("https://gitlab.com/"), host, F.lit("/r.git"))).alias("https"), X.git_url(F.concat("url", F.lit(".git"))).alias("other")
    )


@query("SELECT event_id, 'o' || user_id || '/r#' || event_id AS pr FROM events")
def fn_09_pull_request_url(spark, d):
    url = F.concat(F.lit("https://github.com/o"), F.col("user_id").cast("string"), F.lit("/r/pull/"), F.col("event_id").cast("string"), F.lit("/files?x=1"))
    pr = X.pull_request_url(url)
    return table(spark, d, "events").select("event_id", F.concat(pr["owner"], F.lit("/"), pr["repo"], F.lit("#"), pr["number"].cast("string")).alias("pr"))


@query("SELECT event_id, CAST(user_id AS VARCHAR) || ',' || CAST(event_id AS VARCHAR) || '7' AS refs FROM events")
def fn_10_issue_refs(spark, d):
    body = F.concat(F.lit("Closes #"), F.col("event_id").cast("string"), F.lit("7 and FIXES  #"), F.col("user_id").cast("string"), F.lit(", fixes#"), F.col("user_id").cast("string"))
    return table(spark, d, "events").select("event_id", F.array_join(X.issue_refs(body), ",").alias("refs"))


@query("SELECT page_id, translate(url, '/_', '--') AS name, translate(translate(url, '/_', '--'), '-', '/') AS back FROM pages")
def fn_12_project_path(spark, d):
    name = X.sanitize_project("url")
    return table(spark, d, "pages").select("page_id", name.alias("name"), X.unsanitize_project(name).alias("back"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'file_write' WHEN 'view' THEN 'file_read' WHEN 'purchase' THEN 'shell' WHEN 'signup' THEN 'delegation' END AS category FROM events")
def fn_13_tool_category(spark, d):
    tool = F.create_map(*[F.lit(x) for x in ("click", "Edit", "view", "Read", "purchase", "Bash", "signup", "Task", "error", "Unheard")])
    return table(spark, d, "events").select("event_id", X.tool_category(tool[F.col("event_type")]).alias("category"))


@query("SELECT conv_id, turn, role FROM conversations")
def fn_14_role(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.role(F.upper("role")).alias("role"))


@query(f"{_STEPS} SELECT step_id, CASE split_part(actor, ':', 1) WHEN 'human' THEN '#cce5ff' WHEN 'agent' THEN '#d4edda' WHEN 'tool' THEN '#fff3cd' WHEN 'ci' THEN '#e2d5f1' ELSE '#f8f9fa' END AS colour FROM steps")
def fn_15_actor_color(spark, d):
    return A.event_steps(spark, d).select("step_id", X.actor_color("actor").alias("colour"))


@query(f"{_STEPS} SELECT step_id, split_part(actor, ':', 1) AS kind, split_part(actor, ':', 2) AS name FROM steps")
def fn_16_actor_parts(spark, d):
    return A.event_steps(spark, d).select("step_id", X.actor_type("actor").alias("kind"), X.actor_name("actor").alias("name"))


@query("""SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS html, replace(replace(replace(html, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n') AS dot FROM pages""".replace("\\\\\\\\", "\\\\"))
def fn_17_escape(spark, d):
    return table(spark, d, "pages").select("page_id", X.escape_html("html").alias("html"), X.escape_dot("html").alias("dot"))


# a year of five digits has a sign, as in the captured format (ISO 8601)
@query("SELECT event_id, CASE WHEN event_id * 86461 >= 253402300800 THEN '+' ELSE '' END || strftime(make_timestamp(event_id * 86461 * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS ts FROM events")
def fn_18_utc_text(spark, d):
    return table(spark, d, "events").select("event_id", X.utc_text(F.col("event_id") * 86461).alias("ts"))


@query(f"{_STEPS} SELECT step_id, rtrim(split_part(ts, 'T', 2), 'Z') AS time FROM steps")
def fn_19_time_of_day(spark, d):
    return A.event_steps(spark, d).select("step_id", X.time_of_day("ts").alias("time"))


@query("SELECT page_id, split_part(url, '/', -1) AS name FROM pages")
def fn_23_basename(spark, d):
    return table(spark, d, "pages").select("page_id", X.basename("url").alias("name"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'file' WHEN page_id % 3 = 1 THEN 'document' ELSE 'vcs' END AS kind FROM pages")
def fn_27_base_kind(spark, d):
    uri = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("file://"), "url")).when(F.col("page_id") % 3 == 1, F.lit("path:p/s")).otherwise(F.lit("github:o/r"))
    return table(spark, d, "pages").select("page_id", X.base_kind(uri).alias("kind"))
