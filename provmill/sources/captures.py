"""Captured records of code hosts and git histories.

Nothing here reaches a network: a capture is a folder of JSON or JSON-lines
files, or the text of ``git log``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The format to capture git histories with: fields end with a unit separator, commits with a record separator.
GIT_FORMAT = "%H%x1f%P%x1f%an%x1f%ae%x1f%ct%x1f%B%x1e"
KINDS = ("commit", "review_comment", "issue_comment", "review", "check_run")


def pull_request_records(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(pulls, records) of a folder with one sub-folder a pull request: pull.json and <kind>s.jsonl."""
    def read(pattern: str) -> DataFrame:
        lines = spark.read.text(f"{folder.rstrip('/')}/*/{pattern}", wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
        return lines.withColumn("path_id", F.element_at(F.split("file", "/"), -2))

    pulls = read("pull.json").select("path_id", F.col("value").alias("raw"))
    lines = read("*s.jsonl").select("path_id", F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"s\.jsonl$", "").alias("kind"), F.posexplode(F.split("value", "\r?\n")).alias("ord", "raw"))
    return pulls, lines.where(F.col("kind").isin(*KINDS) & F.col("raw").rlike(r"\S"))


def git_log(spark: SparkSession, path: str) -> DataFrame:
    """Commits of captures in GIT_FORMAT, oldest first: path_id (the file's name), pos, sha, parents, author_name, author_email, time, message."""
    raw = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("path_id"), F.posexplode(F.filter(F.split("value", "\x1e"), lambda x: x.rlike(r"\S"))).alias("newest", "r"))
    f = lambda i: F.get(F.split(F.regexp_replace("r", "^\\s+", ""), "\x1f"), i)
    count = raw.groupBy("path_id").agg(F.max("newest").alias("last"))
    rows = raw.join(count, "path_id").withColumn("pos", F.col("last") - F.col("newest"))
    return rows.select("path_id", "pos", f(0).alias("sha"), F.filter(F.split(f(1), " "), lambda p: p != "").alias("parents"), f(2).alias("author_name"), f(3).alias("author_email"), f(4).cast("long").alias("time"), f(5).alias("message"))


def token(variable: str = "GITHUB_TOKEN") -> str | None:
    """A token for whoever makes captures, from the environment of the driver."""
    return os.environ.get(variable) or None



def git_patches(spark: SparkSession, path: str) -> DataFrame:
    """(sha, path, patch) of captures of ``git log -p --first-parent -m --format=%x1e%H``.

    A patch starts with its first hunk; binary files and files without a hunk
    have none.  A file's name is the new one, or the old one where it is gone.
    """
    raw = spark.read.option("lineSep", "\x1e").text(path).where(F.col("value").rlike(r"\S"))
    sha = F.regexp_extract("value", r"^\s*([0-9a-f]+)", 1)
    return patches(raw.select(sha.alias("sha"), "value"))


def patches(raw: DataFrame) -> DataFrame:
    """git_patches() of commits at hand: sha, value."""
    parts = raw.select("sha", F.explode(F.slice(F.split("value", "(?m)^diff --git "), 2, 1_000_000)).alias("part"))
    name = lambda mark, side: F.nullif(F.regexp_extract("part", rf"(?m)^{mark} {side}/(.*?)\t?$", 1), F.lit(""))
    hunks = F.regexp_extract("part", r"(?ms)^(@@ .*)", 1)
    return parts.select("sha", F.coalesce(name(r"\+\+\+", "b"), name("---", "a")).alias("path"), hunks.alias("patch")).where("patch <> '' and path is not null")


def pull_request_list(raw: DataFrame) -> DataFrame:
    """number, title, state, author, head_branch, base_branch, created_at, updated_at of captured pull requests (column raw, JSON)."""
    g = lambda path, other: F.coalesce(F.get_json_object("raw", path), F.lit(other))
    return raw.select(
        g("$.number", "0").try_cast("long").alias("number"), g("$.title", "").alias("title"), g("$.state", "").alias("state"), g("$.user.login", "unknown").alias("author"), g("$.head.ref", "unknown").alias("head_branch"), g("$.base.ref", "unknown").alias("base_branch"), g("$.created_at", "").alias("created_at"), g("$.updated_at", "").alias("updated_at"),
    )


def default_branch(names: list[str]) -> str | None:
    """The first of main, master, trunk, develop that there is."""
    return next((n for n in ("main", "master", "trunk", "develop") if n in names), None)
