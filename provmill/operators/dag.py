"""Closures and other operators on step graphs.

``steps`` has path_id, step_id, parents and pos; ``heads`` has path_id and head.
Everything is scoped to a path.  Of steps with equal ids the last one (by pos)
defines the parents; filters keep all of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PATH = ("path_id",)

#: Paths of more steps than this are closed over the whole cluster, as a task holds a path's ids in memory; the result is the same.
STEPS_IN_A_TASK = 1_000_000


def edges(steps: DataFrame) -> DataFrame:
    """(path_id, child, parent, ord) of every parent link."""
    return steps.select("path_id", F.col("step_id").alias("child"), F.posexplode("parents").alias("ord", "parent"))


def step_index(steps: DataFrame) -> DataFrame:
    """One row for each step id of a path: the last definition."""
    return steps.groupBy("path_id", "step_id").agg(F.max_by(F.struct(*[c for c in steps.columns if c not in ("path_id", "step_id")]), "pos").alias("step")).select("path_id", "step_id", "step.*")


def _closed(last: dict, heads: list) -> set:
    """What the heads descend from, themselves included; ``last`` has the parents of each step."""
    seen: set = set()
    stack = list(heads)
    while stack:
        step = stack.pop()
        if step is not None and step not in seen:
            seen.add(step)
            stack.extend(last.get(step) or ())
    return seen


def _paths(batches: Iterator[pa.RecordBatch], at: dict[str, int]) -> Iterator[tuple[str | None, list[pa.RecordBatch], dict, list]]:
    """(path, its step rows, parents by step, heads) one after the other; rows come sorted by path, heads first, then by pos."""

    def runs():
        for batch in batches:
            names = np.array([*batch.column(at["path_id"]).to_pylist(), ""], object)[:-1]
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if y > x:
                    yield names[x], batch.slice(x, y - x)

    for path, run in groupby(runs(), key=lambda r: r[0]):
        held, last, heads = [], {}, []
        for _, part in run:
            n = pc.sum(part.column(at["__head"])).as_py() or 0
            heads += part.column(at["step_id"]).slice(0, n).to_pylist()
            rows = part.slice(n)
            if rows.num_rows:
                held.append(rows)
                last.update(zip(rows.column(at["step_id"]).to_pylist(), rows.column(at["parents"]).to_pylist(), strict=True))
        yield path, held, last, heads


def _gathered(steps: DataFrame, heads: DataFrame) -> DataFrame:
    """Steps and heads in one shuffle by path.

    Dealt by a hash of the path: a union of sides that were joined by path
    before would count as dealt already, and loses that when Spark replans it.
    """
    given = heads.select("path_id", F.col("head").alias("step_id"), F.lit(True).alias("__head"))
    rows = steps.withColumn("__head", F.lit(False)).unionByName(given, allowMissingColumns=True)
    return rows.repartition(F.xxhash64("path_id")).sortWithinPartitions("path_id", F.desc("__head"), "pos")


def closure_in_tasks(steps: DataFrame, heads: DataFrame) -> DataFrame:
    """One shuffle by path; each task searches its paths one after the other."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, _, last, tips in _paths(batches, {"path_id": 0, "step_id": 1, "parents": 2, "pos": 3, "__head": 4}):
            seen = _closed(last, tips)
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(seen), pa.string()), pa.array(list(seen), pa.string())], names=["path_id", "step_id"])

    return _gathered(steps.select("path_id", "step_id", "parents", "pos"), heads).mapInArrow(_joined(search), "path_id string, step_id string")


def marked_in_tasks(steps: DataFrame, heads: DataFrame) -> DataFrame:
    """marked() by one shuffle: a task searches its paths and returns their rows."""
    kept = steps.columns
    schema = T.StructType([*steps.schema.fields, T.StructField("active", T.BooleanType()), T.StructField("active_parents", T.ArrayType(T.BooleanType())), T.StructField("headed", T.BooleanType())])
    at = {name: i for i, name in enumerate([*kept, "__head"])}

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for _, held, last, tips in _paths(batches, at):
            seen = _closed(last, tips)
            headed = any(t is not None for t in tips)
            for rows in held:
                active = [s in seen for s in rows.column(at["step_id"]).to_pylist()]
                parents = [None if p is None else [x in seen for x in p] for p in rows.column(at["parents"]).to_pylist()]
                cols = [rows.column(i).cast(arrow.field(i).type) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(active, pa.bool_()), pa.array(parents, pa.list_(pa.bool_())), pa.array([headed] * len(active), pa.bool_())], schema=arrow)

    return _gathered(steps, heads).mapInArrow(_joined(search), schema)


def marks(head, ids, parents):
    """marked() of a path whose steps are in one row: for each step an array of 0 or 1 (the head descends from it), then for each parent 0 (no step of the path), 1 (a step), or 2 (a step, and the head descends from it); empty for null."""

    @F.arrow_udf("array<array<tinyint>>")
    def run(head: pa.Array, ids: pa.Array, parents: pa.Array) -> pa.Array:
        # flat values and lengths: making Python lists of nested arrays takes longer than the search
        size = lambda lists: pc.fill_null(pc.list_value_length(lists), 0).to_pylist()
        links = parents.flatten()
        step, degree, parent = iter(ids.flatten().to_pylist()), iter(size(links)), iter(links.flatten().to_pylist())
        values, inner, outer = [], [0], [0]
        for tip, n in zip(head.to_pylist(), size(ids), strict=True):
            steps = list(islice(step, n))
            of = [list(islice(parent, k)) for k in islice(degree, n)]
            last = dict(zip(steps, of, strict=True))
            seen = _closed(last, [tip])
            for s, ps in zip(steps, of, strict=True):
                values.append(int(s in seen))
                values += [1 + (p in seen) if p in last else 0 for p in ps]
                inner.append(len(values))
            outer.append(len(inner) - 1)
        each = pa.ListArray.from_arrays(pa.array(inner, pa.int32()), pa.array(values, pa.int8()))
        return pa.ListArray.from_arrays(pa.array(outer, pa.int32()), each)

    return run(head, ids, parents)


def _joined(search):
    """Small batches of a search put together, so that many short paths don't make many short batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in search(batches):
            held.append(batch)
            rows += batch.num_rows
            if rows >= 10_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


def closure_by_levels(steps: DataFrame, heads: DataFrame) -> DataFrame:
    """The closure by joins over the whole cluster; no path has to fit a task.

    First parents make a forest, in which pointers that double their reach find
    all ancestors of a step in as many joins as the logarithm of the number of
    steps.  Other parents are followed in rounds: as many as there are of them
    on the way that has fewest.
    """
    shared_dir(steps.sparkSession)
    links = edges(step_index(steps)).select("path_id", "child", "parent", "ord").checkpoint()
    first = links.where("ord = 0").select("path_id", F.col("child").alias("step_id"), F.col("parent").alias("to"))
    others = links.where("ord > 0").select("path_id", F.col("child").alias("step_id"), "parent")
    longest = links.groupBy("path_id").count().agg(F.max("count")).first()[0] or 0
    jumps, reach = [first], 1
    while reach < longest:
        onward = jumps[-1].select("path_id", F.col("step_id").alias("to"), F.col("to").alias("further"))
        jump = jumps[-1].join(onward, ["path_id", "to"]).select("path_id", "step_id", F.col("further").alias("to")).checkpoint()
        if jump.isEmpty():
            break
        jumps.append(jump)
        reach *= 2
    key = ["path_id", "step_id"]
    frontier = heads.where("head is not null").select("path_id", F.col("head").alias("step_id")).distinct().checkpoint()
    seen: list[DataFrame] = []
    while not frontier.isEmpty():
        up = frontier
        for jump in jumps:
            up = up.unionByName(up.join(jump, key).select("path_id", F.col("to").alias("step_id"))).distinct().checkpoint()
        for part in seen:
            up = up.join(part, key, "left_anti")
        seen.append(up.checkpoint())
        frontier = seen[-1].join(others, key).select("path_id", F.col("parent").alias("step_id")).distinct()
        for part in seen:
            frontier = frontier.join(part, key, "left_anti")
        frontier = frontier.checkpoint()
        if len(seen) > 8:  # one table in place of many
            whole = seen[0]
            for part in seen[1:]:
                whole = whole.unionByName(part)
            seen = [whole.checkpoint()]
    out = frontier  # empty
    for part in seen:
        out = out.unionByName(part)
    return out


def _by_block(rows: DataFrame, work, schema: str) -> DataFrame:
    """``work(entries, links)`` of each path and block: (step) that are asked for, and {child: [(parent, elsewhere)]}; gives tuples after the path."""
    names = [c.split()[0] for c in schema.split(", ")]
    in_order = rows.repartition(F.xxhash64("path_id", "block")).sortWithinPartitions("path_id", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.schema([(n, pa.string()) for n in names])
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows, strict=True)], schema=arrow)

        def results():
            at, entries, links = None, set(), {}
            for batch in batches:
                for path, block, child, parent, elsewhere in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if (path, block) != at:
                        if at is not None:
                            yield from ((at[0], *x) for x in work(entries, links))
                        at, entries, links = (path, block), set(), {}
                    if elsewhere is None:
                        entries.add(child)
                    else:
                        links.setdefault(child, []).append((parent, elsewhere))
            if at is not None:
                yield from ((at[0], *x) for x in work(entries, links))

        held = []
        for row in results():
            held.append(row)
            if len(held) >= 10_000:
                yield made(held)
                held = []
        if held:
            yield made(held)

    return in_order.select("path_id", "block", "child", "parent", "elsewhere").mapInArrow(run, schema)


#: A block's reachability is listed entry by entry up to so many steps of search, beyond that its links stand for themselves.
MOST_SEARCH = 20_000_000


def _across(entries: set, links: dict) -> Iterator[tuple[str, str]]:
    """(entry, step of another block) as each entry leads there; or links that lead there as well."""
    if len(entries) * len(links) > MOST_SEARCH:
        for child, parents in links.items():
            yield from ((child, p) for p, _ in parents)
        return
    for entry in entries:
        seen, stack, out = {entry}, [entry], set()
        while stack:
            for parent, elsewhere in links.get(stack.pop(), ()):
                if elsewhere:
                    out.add(parent)
                elif parent not in seen:
                    seen.add(parent)
                    stack.append(parent)
        yield from ((entry, p) for p in out)


def _within(entries: set, links: dict) -> Iterator[tuple[str]]:
    """All that the entries lead to inside the block."""
    seen, stack = set(entries), list(entries)
    while stack:
        for parent, elsewhere in links.get(stack.pop(), ()):
            if not elsewhere and parent not in seen:
                seen.add(parent)
                stack.append(parent)
    yield from ((s,) for s in seen)


def closure_by_blocks(steps: DataFrame, heads: DataFrame, most_steps: int = STEPS_IN_A_TASK, span: int | None = None) -> DataFrame:
    """The closure of paths that don't fit a task.

    A path is cut into blocks by pos.  A task finds, for each step of its block
    that another block's step has as a parent (an entry), and each head, which
    steps of other blocks it leads to.  Entries and these links are a smaller
    graph, which is closed the same way, or in a task once it is small enough.
    Then each block is searched from the entries that turned out to be reached.
    So each level is two passes, whatever the order of parents, and each level
    is smaller; a graph that doesn't get smaller is closed link by link
    (closure_by_levels()).
    """
    span = span or most_steps
    index = cut(step_index(steps).select("path_id", "step_id", "parents", "pos"))
    place = index.select("path_id", "step_id", F.floor(F.col("pos") / span).alias("block"), "pos")
    links = index.select("path_id", F.floor(F.col("pos") / span).alias("block"), F.col("step_id").alias("child"), F.explode("parents").alias("parent"))
    of_parent = place.select("path_id", F.col("step_id").alias("parent"), F.col("block").alias("__to"))
    links = cut(links.join(of_parent, ["path_id", "parent"], "left").withColumn("elsewhere", F.coalesce(F.col("__to") != F.col("block"), F.lit(False))))
    asked = heads.where("head is not null").select("path_id", F.col("head").alias("step_id")).distinct()
    entered = links.where("elsewhere").select("path_id", F.col("parent").alias("step_id")).distinct().unionByName(asked).distinct()
    none = F.lit(None)
    entry_rows = lambda rows: rows.join(place, ["path_id", "step_id"]).select("path_id", "block", F.col("step_id").alias("child"), none.cast("string").alias("parent"), none.cast("boolean").alias("elsewhere"))
    link_rows = links.select("path_id", "block", "child", "parent", "elsewhere")
    between = cut(_by_block(entry_rows(entered).unionByName(link_rows), _across, "path_id string, child string, parent string"))
    smaller = between.groupBy("path_id", F.col("child").alias("step_id")).agg(F.collect_set("parent").alias("parents")).join(place.drop("block"), ["path_id", "step_id"])
    smaller = cut(smaller.unionByName(entered.join(place.drop("block"), ["path_id", "step_id"]).join(between.select("path_id", F.col("child").alias("step_id")), ["path_id", "step_id"], "left_anti").withColumn("parents", F.array().cast("array<string>"))))
    size = smaller.groupBy("path_id").agg(F.count("*").alias("n"), F.sum(F.size("parents")).alias("links")).agg(F.max("n"), F.sum("n"), F.sum("links")).first()
    if (size[0] or 0) <= most_steps:
        reached = closure_in_tasks(smaller, asked.withColumnRenamed("step_id", "head"))
    elif 2 * (size[1] + size[2]) > index.count() + links.count():
        return closure_by_levels(steps, heads)
    else:
        reached = closure_by_blocks(smaller, asked.withColumnRenamed("step_id", "head"), most_steps, 2 * span)
    reached = cut(reached)
    inside = _by_block(entry_rows(reached.select("path_id", "step_id").distinct()).unionByName(link_rows), _within, "path_id string, step_id string")
    return inside.unionByName(asked).distinct()


def closure_by_cte(steps: DataFrame, heads: DataFrame, levels: int = 1000) -> DataFrame:
    """Recursive SQL; it lists walks, so only for tree-like graphs."""
    edges(step_index(steps)).createOrReplaceTempView("__edges")
    heads.createOrReplaceTempView("__heads")
    return steps.sparkSession.sql(
        f"""WITH RECURSIVE walk(path_id, step_id) MAX RECURSION LEVEL {levels} AS (
              SELECT path_id, head FROM __heads WHERE head IS NOT NULL
              UNION ALL SELECT w.path_id, e.parent FROM walk w JOIN __edges e ON e.path_id = w.path_id AND e.child = w.step_id)
            SELECT DISTINCT path_id, step_id FROM walk"""
    )


def _large(steps: DataFrame, most_steps: int) -> DataFrame | None:
    """(path_id) of paths with more steps, or None if there is none; the count reads no other column."""
    large = steps.groupBy("path_id").count().where(F.col("count") > most_steps).select("path_id")
    return None if large.isEmpty() else large


def ancestor_ids(steps: DataFrame, heads: DataFrame, most_steps: int = STEPS_IN_A_TASK) -> DataFrame:
    """(path_id, step_id): what each head descends from, itself included.

    A head or parent that is no step is part of it too; cycles end.  Paths too
    large for a task are closed over the whole cluster.
    """
    large = _large(steps, most_steps)
    if large is None:
        return closure_in_tasks(steps, heads)
    of = lambda rows, how: rows.join(large, "path_id", how)
    return closure_in_tasks(of(steps, "left_anti"), of(heads, "left_anti")).unionByName(closure_by_blocks(of(steps, "left_semi"), of(heads, "left_semi"), most_steps))


def marked(steps: DataFrame, heads: DataFrame, most_steps: int = STEPS_IN_A_TASK) -> DataFrame:
    """``steps`` with active (a head descends from it), active_parents (the same of each parent) and headed (its path has a head)."""
    large = _large(steps, most_steps)
    if large is None:
        return marked_in_tasks(steps, heads)
    of = lambda rows, how: rows.join(large, "path_id", how)
    some, tips = of(steps, "left_semi"), of(heads, "left_semi").where("head is not null")
    on = closure_by_blocks(some, tips, most_steps)
    links = some.select("path_id", "step_id", "pos", F.posexplode("parents").alias("__ord", "__parent"))
    known = links.join(on.select("path_id", F.col("step_id").alias("__parent"), F.lit(True).alias("__on")), ["path_id", "__parent"], "left")
    flags = F.transform(F.array_sort(F.collect_list(F.struct("__ord", F.coalesce("__on", F.lit(False)).alias("on")))), lambda x: x["on"])
    parents = known.groupBy("path_id", "step_id", "pos").agg(flags.alias("active_parents"))
    out = some.join(on.withColumn("active", F.lit(True)), ["path_id", "step_id"], "left").join(parents, ["path_id", "step_id", "pos"], "left").join(tips.select("path_id", F.lit(True).alias("headed")).distinct(), "path_id", "left")
    none = F.when(F.col("parents").isNotNull(), F.array().cast("array<boolean>"))
    out = out.select(*steps.columns, F.coalesce("active", F.lit(False)).alias("active"), F.coalesce("active_parents", none).alias("active_parents"), F.coalesce("headed", F.lit(False)).alias("headed"))
    return marked_in_tasks(of(steps, "left_anti"), of(heads, "left_anti")).unionByName(out)


def ancestors(steps: DataFrame, heads: DataFrame) -> DataFrame:
    """The steps that a head descends from, the head included."""
    return marked(steps, heads).where("active").select(*steps.columns)


def dead_ends(steps: DataFrame, heads: DataFrame, need_head: bool = False) -> DataFrame:
    """The steps that no head descends from: all steps of a path whose head is unknown.

    A path without any head has none, or raises if ``need_head``.
    """
    if need_head:
        bare = headless(steps, heads).select("path_id").first()
        if bare:
            raise ValueError(f"path {bare[0]} has no head")
    return marked(steps, heads).where("headed and not active").select(*steps.columns)


def headless(steps: DataFrame, heads: DataFrame) -> DataFrame:
    """(path_id, n_steps) of paths without a head, for which nothing can be a dead end."""
    known = heads.where("head is not null").select("path_id").distinct()
    return steps.groupBy("path_id").agg(F.count("*").alias("n_steps")).join(known, "path_id", "left_anti")


def roots(steps: DataFrame) -> DataFrame:
    """Steps without parents."""
    return steps.where(F.size("parents") == 0)


def graph_roots(steps: DataFrame, scope: str = "graph_id") -> DataFrame:
    """Steps none of whose parents is a step of the graph."""
    known = steps.select(scope, F.col("step_id").alias("__parent")).distinct()
    linked = steps.select(scope, "path_id", "step_id", F.explode("parents").alias("__parent")).join(known, [scope, "__parent"], "left_semi")
    return steps.join(linked.select(scope, "path_id", "step_id").distinct(), [scope, "path_id", "step_id"], "left_anti")


def active_edges(steps: DataFrame, heads: DataFrame) -> DataFrame:
    """edges() with active: both ends are in the head's closure."""
    rows = marked(steps.select("path_id", "step_id", "parents", "pos"), heads)
    each = rows.select("path_id", F.col("step_id").alias("child"), "active", F.posexplode(F.arrays_zip("parents", "active_parents")).alias("ord", "__p"))
    return each.select("path_id", "child", F.col("__p.parents").alias("parent"), "ord", (F.col("active") & F.col("__p.active_parents")).alias("active"))


def degrees(steps: DataFrame) -> DataFrame:
    """(path_id, step_id, n_parents, n_children): a merge has several parents, a fork several children."""
    children = edges(steps).groupBy("path_id", F.col("parent").alias("step_id")).agg(F.count("*").alias("n_children"))
    return steps.select("path_id", "step_id", F.size("parents").cast("long").alias("n_parents")).join(children, ["path_id", "step_id"], "left").na.fill({"n_children": 0})


def children(steps: DataFrame) -> DataFrame:
    """(path_id, step_id, child) of every reverse link."""
    return edges(steps).select("path_id", F.col("parent").alias("step_id"), "child")


def trunk_ancestors(steps: DataFrame, heads: DataFrame) -> DataFrame:
    """ancestors() of paths that are one chain in order of pos: a comparison, no closure."""
    at = steps.join(heads.select("path_id", F.col("head").alias("step_id")), ["path_id", "step_id"]).select("path_id", F.col("pos").alias("__at"))
    return steps.join(at, "path_id").where("pos <= __at").drop("__at")


def cut(rows: DataFrame) -> DataFrame:
    """Rows written once to the shared folder, so that what builds on them neither repeats their work nor carries their plan."""
    shared_dir(rows.sparkSession)
    return rows.checkpoint()


def stored(rows: DataFrame) -> DataFrame:
    """cut() for wide rows that are read several times, some columns each time: by column, so that each reading takes what it needs."""
    folder = f"{shared_dir(rows.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


@contextmanager
def freed(spark) -> Iterator[None]:
    """What is run inside gives up its shuffles' files as it ends, not when the driver happens to forget them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shared_dir(spark) -> str:
    """The folder for checkpoints: the cluster's, or a local one where none is set (local mode)."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        named = tempfile.mkdtemp(prefix="checkpoints-")
    sc.setCheckpointDir(named)
    return named
