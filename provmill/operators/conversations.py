"""Operators on turns: path_id, pos, turn_id, role, text (and what a caller adds)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provmill.functions import text as X


def by_role(turns: DataFrame, role: str) -> DataFrame:
    return turns.where(F.col("role") == role)


def contains_text(turns: DataFrame, search: str) -> DataFrame:
    """Turns whose text holds ``search``, whatever the case."""
    return turns.where(F.contains(F.lower("text"), F.lower(F.lit(search))))


def conversations_with_text(turns: DataFrame, search: str) -> DataFrame:
    """All turns of conversations with at least one hit."""
    return turns.join(contains_text(turns, search).select("path_id").distinct(), "path_id", "left_semi")


def since(turns: DataFrame, marks: DataFrame) -> DataFrame:
    """Turns after the first one with the mark's id; all turns where that is unknown.  ``marks``: path_id, turn_id."""
    known = turns.join(marks, ["path_id", "turn_id"]).groupBy("path_id").agg(F.min("pos").alias("__at"))
    return turns.join(known, "path_id", "left").where(F.col("pos") > F.coalesce("__at", F.lit(-1))).drop("__at")


def titles(turns: DataFrame, n: int) -> DataFrame:
    """(path_id, title): the first user text that isn't empty, cut to n characters and three dots."""
    first = turns.where("role = 'user' and text <> ''").groupBy("path_id").agg(F.min_by("text", "pos").alias("text"))
    return first.select("path_id", X.title("text", n).alias("title"))


def chained(rows: DataFrame, order: list, id: str = "step_id", path: str = "path_id") -> DataFrame:
    """Rows with parent: the id of the row before, in order."""
    return rows.withColumn("parent", F.lag(id).over(Window.partitionBy(path).orderBy(*order)))


def main_line(rows: DataFrame, side: str = "is_sidechain", id: str = "step_id", path: str = "path_id", pos: str = "pos") -> DataFrame:
    """Rows with parent: the last row before that is no side chain."""
    before = Window.partitionBy(path).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("parent", F.last(F.when(~F.col(side), F.col(id)), ignorenulls=True).over(before))


def first_seen(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """Of rows with equal keys the first."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__k = 1").drop("__k")


def usage(turns: DataFrame) -> DataFrame:
    """Sums of a conversation's token counts; null where no turn has any.

    Of turns with usage, a missing input or output counts 0; cache counters stay
    null if no turn has them.
    """
    has = F.col("usage").isNotNull()
    plain = lambda c: F.sum(F.when(has, F.coalesce(F.col(f"usage.{c}"), F.lit(0))))
    return turns.groupBy("path_id").agg(plain("input_tokens").alias("input_tokens"), plain("output_tokens").alias("output_tokens"), F.sum("usage.cache_read_tokens").alias("cache_read_tokens"), F.sum("usage.cache_write_tokens").alias("cache_write_tokens"))


def bounds(rows: DataFrame, instant: str = "at") -> DataFrame:
    """(path_id, started_at, last_activity, seconds) of rows with a readable time."""
    ends = rows.groupBy("path_id").agg(F.min(instant).alias("started_at"), F.max(instant).alias("last_activity"))
    return ends.withColumn("duration", F.col("last_activity") - F.col("started_at"))


def first_touch(calls: DataFrame) -> DataFrame:
    """(path_id, file, ord): files in the order in which they were first written.  ``calls``: path_id, pos, call_pos, file."""
    first = calls.where("file is not null").groupBy("path_id", "file").agg(F.min(F.struct("pos", "call_pos")).alias("__at"))
    return first.select("path_id", "file", F.row_number().over(Window.partitionBy("path_id").orderBy("__at", "file")).alias("ord"))


def recent(rows: DataFrame, n: int, instant: str, tie: str) -> DataFrame:
    """The n latest rows; earlier rows first among equals."""
    return rows.orderBy(F.desc_nulls_last(instant), F.asc(tie)).limit(n)


def latest_first(rows: DataFrame, instant: str, tie: str, n: int) -> DataFrame:
    """The n latest rows with place, counted from 1; rows without a time come last."""
    best = recent(rows, n, instant, tie)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last(instant), F.asc(tie))).cast("long"))


def summaries(steps: DataFrame) -> DataFrame:
    """(path_id, n_steps, last_pos) of each session."""
    return steps.groupBy("path_id").agg(F.count("*").alias("n_steps"), F.max("pos").cast("long").alias("last_pos"))


def seen_and_last(rows: DataFrame, seen: str, last: str) -> DataFrame:
    """(path_id, seen_count, last_id): how many values of a column there are, and the last of another."""
    return rows.groupBy("path_id").agg(F.count_distinct(seen).alias("seen_count"), F.max_by(last, "pos").alias("last_id"))


def step_labels(rows: DataFrame, id: str = "step_id") -> DataFrame:
    """(path_id, id, label): step-001 and so on, in order of pos."""
    n = F.row_number().over(Window.partitionBy("path_id").orderBy("pos")).cast("string")
    return rows.select("path_id", id, F.concat(F.lit("step-"), F.lpad(n, F.greatest(F.length(n), F.lit(3)), "0")).alias("label"))
