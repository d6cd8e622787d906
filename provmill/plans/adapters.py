"""Provenance and conversation views of the star-schema tables.

Steps have: path_id, pos, step_id, parents, actor, ts (text), artifact, event_type, value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def iso(ts) -> F.Column:
    """Seconds as text; the time has no zone."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as steps: a user is a path.

    An event that is no error follows the user's last such event; an error hangs
    off it as a side branch; a sign-up right after an error also has the error
    as a parent and so merges the branch.
    """
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ok = F.when(F.col("event_type") != "error", F.col("event_id"))
    trunk = F.last(ok, ignorenulls=True).over(by_user.rowsBetween(Window.unboundedPreceding, -1))
    merged = F.when((F.col("event_type") == "signup") & (F.lag("event_type").over(by_user) == "error"), F.lag("event_id").over(by_user))
    kind = F.col("event_type")
    actor = (
        F.when(kind.isin("view", "click"), F.concat(F.lit("human:u"), F.col("user_id").cast("string")))
        .when(kind == "purchase", "agent:checkout")
        .when(kind == "signup", "ci:onboard")
        .otherwise("tool:monitor")
    )
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("path_id"),
        F.row_number().over(by_user).alias("pos"),
        F.col("event_id").cast("string").alias("step_id"),
        F.array_compact(F.array(trunk.cast("string"), merged.cast("string"))).alias("parents"),
        actor.alias("actor"),
        iso(F.col("ts")).alias("ts"),
        F.concat(F.lit("k/"), F.get_json_object("props", "$.k")).alias("artifact"),
        "event_type",
        "value",
    )


def event_heads(steps: DataFrame) -> DataFrame:
    """(path_id, head): the last step of each path that isn't an error."""
    return steps.where("event_type <> 'error'").groupBy("path_id").agg(F.max_by("step_id", "pos").alias("head"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation rows: path_id, pos, turn_id, role, text."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("path_id"), F.col("turn").alias("pos"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("turn_id"), "role", "text")


def order_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as steps of orders, orders as paths of a customer's graph; the part is the revision."""
    kept = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    order = Window.partitionBy("path_id").orderBy(*kept)  # by what is joined and grouped too, so lines are dealt once
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("path_id"), *kept).select(
        "path_id", F.row_number().over(order).alias("pos"), F.col("l_partkey").cast("string").alias("revision"), F.col("l_suppkey").cast("string").alias("supplier"), iso(F.col("l_shipdate")).alias("ts")
    )
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path_id"), F.col("o_custkey").cast("string").alias("graph_id"))
    return lines.join(orders, "path_id").withColumn("step_id", F.concat_ws("-", "path_id", "pos"))


#: DuckDB twins of the views above.
EVENT_STEPS_SQL = """
ev AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos,
    last_value(CASE WHEN event_type <> 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS trunk,
    lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_type
  FROM events),
steps AS (
  SELECT CAST(user_id AS VARCHAR) AS path_id, pos, CAST(event_id AS VARCHAR) AS step_id, CAST(trunk AS VARCHAR) AS parent1,
    CASE WHEN event_type = 'signup' AND prev_type = 'error' THEN CAST(prev AS VARCHAR) END AS parent2,
    CASE WHEN event_type IN ('view', 'click') THEN 'human:u' || CAST(user_id AS VARCHAR) WHEN event_type = 'purchase' THEN 'agent:checkout' WHEN event_type = 'signup' THEN 'ci:onboard' ELSE 'tool:monitor' END AS actor,
    strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts, 'k/' || json_extract_string(props, '$.k') AS artifact, event_type, value
  FROM ev),
edges AS (
  SELECT path_id, step_id AS child, parent1 AS parent FROM steps WHERE parent1 IS NOT NULL
  UNION ALL SELECT path_id, step_id, parent2 FROM steps WHERE parent2 IS NOT NULL),
heads AS (SELECT path_id, arg_max(step_id, pos) AS head FROM steps WHERE event_type <> 'error' GROUP BY path_id)"""

CLOSURE_SQL = """
closure AS (
  SELECT path_id, head AS step_id FROM heads
  UNION
  SELECT c.path_id, e.parent FROM closure c JOIN edges e ON e.path_id = c.path_id AND e.child = c.step_id)"""

TURNS_SQL = "turns AS (SELECT CAST(conv_id AS VARCHAR) AS path_id, turn AS pos, CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS turn_id, role, text FROM conversations)"

ORDER_STEPS_SQL = """
lines AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS path_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS pos,
    CAST(l_partkey AS VARCHAR) AS revision, CAST(l_suppkey AS VARCHAR) AS supplier, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') AS ts FROM lineitem),
osteps AS (
  SELECT l.*, CAST(o_custkey AS VARCHAR) AS graph_id, l.path_id || '-' || CAST(pos AS VARCHAR) AS step_id FROM lines l JOIN orders ON CAST(o_orderkey AS VARCHAR) = l.path_id)"""
