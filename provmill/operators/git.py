"""Branches, merge bases and paths of captured git histories.

``commits``: repo, pos (oldest first, parents before their children), sha,
parents, and what derive.commit_steps() reads; ``branches``: repo, name, tip.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provmill.functions import text as X
from provmill.operators import dag, derive

#: Names of default branches, the first there is counts (fixed values).
DEFAULTS = ("main", "master", "trunk", "develop")


def default_branches(branches: DataFrame) -> DataFrame:
    """(repo, name, tip) of each repository's default branch; repositories without one are left out."""
    rank = F.array_position(F.array(*map(F.lit, DEFAULTS)), F.col("name"))
    known = branches.where(F.col("name").isin(*DEFAULTS))
    return known.groupBy("repo").agg(F.min_by(F.struct("name", "tip"), rank).alias("b")).select("repo", "b.*")


def branch_listing(commits: DataFrame, branches: DataFrame) -> DataFrame:
    """repo, name, tip, subject, author_name and ts of the branches, by name."""
    subject = F.get(F.split(F.btrim("message"), "\r?\n"), 0)
    tips = commits.select("repo", F.col("sha").alias("tip"), subject.alias("subject"), "author_name", X.utc_text("time").alias("ts"))
    return branches.join(tips, ["repo", "tip"], "left").select("repo", "name", "tip", "subject", "author_name", "ts").orderBy("repo", "name")


def repository_uri(remote: Column, git_dir: Column) -> Column:
    """The remote's address, else the folder that holds the git folder, else an unknown file."""
    parent = F.regexp_replace(git_dir, "/[^/]*/?$", "")
    return F.coalesce(X.git_url(remote), F.concat(F.lit("file://"), parent), F.lit("file://unknown"))


# One pass a repository, from the newest commit to the oldest: each commit has a bit for each tip that it is below of,
# passes its bits on to its parents and is done.  What is held is the bits of commits that are still to come.


def numbered(tips: DataFrame, *columns: str) -> DataFrame:
    """The different rows of ``columns`` (repo among them) with n, their number in the repository."""
    rows = tips.select(*columns).distinct()
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("repo").orderBy(*(c for c in columns if c != "repo"))) - 1)


class _Pass:
    """What one repository's pass does; emits rows for ``visit`` and ``end``."""

    def begin(self, asked: list[tuple]) -> None:
        """``asked``: (n, other), what the repository's marks ask for."""

    def visit(self, sha: str, pos: int, below: int, out: int) -> Iterator[tuple]:
        yield from ()

    def end(self) -> Iterator[tuple]:
        yield from ()


def _down(commits: DataFrame, marks: DataFrame, work: type[_Pass], schema: str) -> DataFrame:
    """``work`` over each repository with marks: (repo, n, sha, side, other).

    Bit n of ``below`` is set at commits that a mark of side 0 descends from, of
    ``out`` at those that a mark of side 1 does; side 2 only asks.
    """
    none = lambda kind: F.lit(None).cast(kind)
    asked = marks.select("repo", F.lit(None).cast("long").alias("pos"), "sha", none("array<string>").alias("parents"), F.col("n").cast("int").alias("n"), F.col("side").cast("int").alias("side"), F.col("other").cast("int").alias("other"))
    rows = commits.join(marks.select("repo").distinct(), "repo", "left_semi").select("repo", F.col("pos").cast("long").alias("pos"), "sha", "parents", *(none("int").alias(c) for c in ("n", "side", "other")))
    in_order = rows.unionByName(asked).repartition(F.xxhash64("repo")).sortWithinPartitions("repo", F.desc_nulls_first("pos"))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repo, pass_, bits, asked, begun, out = None, None, {}, [], False, []
        for batch in batches:
            for r, pos, sha, parents, n, side, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if pass_ is None or r != repo:
                    if pass_ is not None:
                        out += [(repo, *x) for x in pass_.end()]
                    repo, pass_, bits, asked, begun = r, work(), {}, [], False
                if pos is None:
                    if side == 2:
                        asked.append((n, other))
                    else:
                        own = bits.setdefault(sha, [0, 0])
                        own[side] |= 1 << n
                    continue
                if not begun:
                    pass_.begin(asked)
                    begun = True
                own = bits.pop(sha, None)
                if own is None:
                    continue
                out += [(repo, *x) for x in pass_.visit(sha, pos, own[0], own[1])]
                for p in parents or ():
                    to = bits.get(p)
                    if to is None:
                        bits[p] = own[:]
                    else:
                        to[0] |= own[0]
                        to[1] |= own[1]
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema=arrow)
                out = []
        if pass_ is not None:
            out += [(repo, *x) for x in pass_.end()]
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema=arrow)

    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    arrow = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])
    return in_order.mapInArrow(run, schema)


def _bits(mask: int) -> Iterator[int]:
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


class _Bitmaps(_Pass):
    def visit(self, sha: str, pos: int, below: int, out: int) -> Iterator[tuple]:
        yield sha, pos, below.to_bytes((below.bit_length() + 7) // 8, "little")


def reach(commits: DataFrame, tips: DataFrame) -> DataFrame:
    """(repo, sha, pos, tips): each commit that a tip descends from, once; bit n of ``tips`` (the least first) is the repository's n-th different tip by sha.

    ``tips``: repo, tip.
    """
    marks = numbered(tips.where("tip is not null"), "repo", "tip").select("repo", "n", F.col("tip").alias("sha"), F.lit(0).alias("side"), F.lit(None).alias("other"))
    return _down(commits, marks, _Bitmaps, "repo string, sha string, pos long, tips binary")


class _Bases(_Pass):
    """Of each pair the first commit that both are below of."""

    def begin(self, asked: list[tuple]) -> None:
        self.wanted: dict[int, int] = {}
        for a, b in asked:
            self.wanted[a] = self.wanted.get(a, 0) | 1 << b
        self.first = sum(1 << a for a in self.wanted)

    def visit(self, sha: str, pos: int, below: int, out: int) -> Iterator[tuple]:
        for a in _bits(below & self.first):
            found = self.wanted[a] & below
            if found:
                self.wanted[a] ^= found
                if not self.wanted[a]:
                    self.first ^= 1 << a
                for b in _bits(found):
                    yield a, b, sha


def merge_bases(commits: DataFrame, pairs: DataFrame) -> DataFrame:
    """(repo, a, b, base): of the commits that both descend from the last, which no other of them descends from; pairs without one are left out."""
    pairs = pairs.select("repo", "a", "b").where("a is not null and b is not null").distinct()
    tips = dag.cut(numbered(pairs.select("repo", F.col("a").alias("tip")).unionByName(pairs.select("repo", F.col("b").alias("tip"))), "repo", "tip"))
    of = lambda side: tips.select("repo", F.col("tip").alias(side), F.col("n").alias(f"n_{side}"))
    asked = pairs.join(of("a"), ["repo", "a"]).join(of("b"), ["repo", "b"]).select("repo", F.col("n_a").alias("n"), F.lit(None).cast("string").alias("sha"), F.lit(2).alias("side"), F.col("n_b").alias("other"))
    marks = tips.select("repo", "n", F.col("tip").alias("sha"), F.lit(0).alias("side"), F.lit(None).cast("int").alias("other")).unionByName(asked)
    found = _down(commits, marks, _Bases, "repo string, n_a int, n_b int, base string")
    return found.join(of("a"), ["repo", "n_a"]).join(of("b"), ["repo", "n_b"]).select("repo", "a", "b", "base")


class _Oldest(_Pass):
    """Of each tip the last commit of the pass; commits below of the same tips replace each other."""

    def __init__(self) -> None:
        self.last: dict[int, tuple[int, str]] = {}

    def visit(self, sha: str, pos: int, below: int, out: int) -> Iterator[tuple]:
        self.last[below] = pos, sha
        yield from ()

    def end(self) -> Iterator[tuple]:
        told = 0
        for below, (_, sha) in sorted(self.last.items(), key=lambda x: x[1][0]):
            for n in _bits(below & ~told):
                yield n, sha
            told |= below


def oldest_commits(commits: DataFrame, tips: DataFrame) -> DataFrame:
    """(repo, tip, oldest): the oldest commit that each tip descends from."""
    known = dag.cut(numbered(tips.where("tip is not null"), "repo", "tip"))
    marks = known.select("repo", "n", F.col("tip").alias("sha"), F.lit(0).alias("side"), F.lit(None).alias("other"))
    return _down(commits, marks, _Oldest, "repo string, n int, oldest string").join(known, ["repo", "n"]).select("repo", "tip", "oldest")


def branch_bases(commits: DataFrame, branches: DataFrame) -> DataFrame:
    """(repo, name, base): where each branch left the default branch.

    For the default branch itself, a tip that the default branch has, and
    histories without a common commit: the oldest commit that the tip descends from.
    """
    default = default_branches(branches).select("repo", F.col("tip").alias("a"))
    pairs = branches.join(default, "repo").where("tip <> a").select("repo", "a", F.col("tip").alias("b"))
    left = merge_bases(commits, pairs).where("base <> b").select("repo", F.col("b").alias("tip"), "base")
    found = branches.join(left, ["repo", "tip"], "left").join(oldest_commits(commits, branches), ["repo", "tip"], "left")
    return found.select("repo", "name", F.coalesce("base", "oldest", "tip").alias("base"))


def default_branch_starts(commits: DataFrame, branches: DataFrame) -> DataFrame:
    """(repo, start): from where a default branch is shown beside others.

    The earliest commit at which another branch left it, and up to two first
    parents further back.  A default branch with a start of its own (column
    start, if there is one) has none.
    """
    default = default_branches(branches)
    if "start" in branches.columns:
        default = default.join(branches.where("start is not null").select("repo", "name"), ["repo", "name"], "left_anti")
    pairs = branches.join(default.select("repo", F.col("name").alias("default"), F.col("tip").alias("a")), "repo").where("name <> default").select("repo", "a", F.col("tip").alias("b"))
    at = merge_bases(commits, pairs).join(commits.select("repo", F.col("sha").alias("base"), "pos"), ["repo", "base"])
    earliest = at.groupBy("repo").agg(F.min_by("base", "pos").alias("sha"))
    up = commits.select("repo", "sha", F.get("parents", 0).alias("up"))
    once = earliest.join(up, ["repo", "sha"], "left")
    twice = once.join(up.select("repo", F.col("sha").alias("up"), F.col("up").alias("further")), ["repo", "up"], "left")
    return twice.select("repo", F.coalesce("further", "up", "sha").alias("start"))


class _Own(_Pass):
    """Commits that a branch's tip is above of and its base isn't."""

    def visit(self, sha: str, pos: int, below: int, out: int) -> Iterator[tuple]:
        for n in _bits(below & ~out):
            yield n, sha


def branch_commits(commits: DataFrame, branches: DataFrame) -> DataFrame:
    """Commits of each branch after its base, oldest first: the columns of ``commits``, name and tip, with pos counted from 0.  ``branches`` also have base."""
    known = dag.cut(numbered(branches, "repo", "name", "tip", "base"))
    mark = lambda c, side: known.where(F.col(c).isNotNull()).select("repo", "n", F.col(c).alias("sha"), F.lit(side).alias("side"), F.lit(None).alias("other"))
    own = _down(commits, mark("tip", 0).unionByName(mark("base", 1)), _Own, "repo string, n int, sha string").join(known, ["repo", "n"]).drop("n")
    order = Window.partitionBy("repo", "name").orderBy("__at")
    return own.join(commits.withColumnRenamed("pos", "__at"), ["repo", "sha"]).withColumn("pos", F.row_number().over(order) - 1).drop("__at")


def branch_id(name: Column | str) -> Column:
    return F.concat(F.lit("path-"), F.replace(F.col(name) if isinstance(name, str) else name, F.lit("/"), F.lit("-")))


def branch_paths(commits: DataFrame, files: DataFrame, branches: DataFrame, repositories: DataFrame | None = None, base: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(paths, steps) of branches: a path for each, a step for each commit after its base.

    The base is ``base`` if that is given, else the branch's start (column
    start, a commit), else the default branch's start where several branches
    are shown, else where the branch left the default branch.
    ``repositories``: repo, remote, git_dir.
    """
    commits, branches = dag.cut(commits), dag.cut(branches)
    given = branches.withColumn("__start", F.col("start") if "start" in branches.columns else F.lit(None).cast("string"))
    several = branches.groupBy("repo").count().where("count > 1").select("repo")
    shown = default_branches(branches).join(several, "repo", "left_semi").join(default_branch_starts(commits, branches), "repo").select("repo", "name", F.col("start").alias("__shown"))
    left = branch_bases(commits, branches).select("repo", "name", F.col("base").alias("__left"))
    based = given.join(shown, ["repo", "name"], "left").join(left, ["repo", "name"], "left").withColumn("base", F.coalesce(F.lit(base).cast("string"), "__start", "__shown", "__left")).select("repo", "name", "tip", "base")
    based = dag.cut(based)
    own = branch_commits(commits, based).withColumn("path_id", F.concat_ws("#", "repo", branch_id("name")))
    steps = derive.commit_steps(own, files)
    last = steps.groupBy("path_id").agg(F.max_by("step_id", "pos").alias("__last"))
    paths = based.withColumn("path_id", F.concat_ws("#", "repo", branch_id("name"))).join(last, "path_id", "left")
    uri = F.lit("file://unknown")
    if repositories is not None:
        paths = paths.join(repositories, "repo", "left")
        uri = repository_uri(F.col("remote"), F.col("git_dir"))
    head = F.coalesce("__last", F.concat(F.lit("step-"), X.prefix("tip", 8)))
    return paths.select("repo", "path_id", uri.alias("base_uri"), F.col("base").alias("base_ref"), head.alias("head"), F.concat(F.lit("Branch: "), "name").alias("title")), steps
