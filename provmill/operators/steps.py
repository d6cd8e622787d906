"""Filters, aggregates, set operations and joins on steps.

Steps have a map ``change`` from artifact to what changed, or one artifact in a
column of its own; both forms are served.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provmill.functions import text as X


def _touches(steps: DataFrame, test) -> Column:
    """Whether any artifact of a step passes the test."""
    if "change" in steps.columns:
        return F.exists(F.map_keys(F.coalesce("change", F.create_map().cast(steps.schema["change"].dataType))), test)
    return test(F.col("artifact"))


def by_actor(steps: DataFrame, start: str) -> DataFrame:
    """Actors that start with ``start``; case counts."""
    return steps.where(F.startswith("actor", F.lit(start)))


def by_artifact(steps: DataFrame, artifact: str) -> DataFrame:
    return steps.where(_touches(steps, lambda a: a == F.lit(artifact)))


def by_artifact_glob(steps: DataFrame, pattern: str) -> DataFrame:
    return steps.where(_touches(steps, lambda a: a.rlike(X.glob_to_regex(pattern))))


def by_time(steps: DataFrame, start: str, end: str, instants: bool = False) -> DataFrame:
    """Times from start to end, both included; compared as text unless ``instants``."""
    if instants:
        return steps.where(F.try_to_timestamp("ts").between(F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end))))
    return steps.where(F.col("ts").between(start, end))


def where(steps: DataFrame, actor: str | None = None, artifact: str | None = None, after: str | None = None, before: str | None = None) -> DataFrame:
    """Steps that pass all given tests.

    The tests go by step id: of steps with equal ids in a path, all stay if the
    tests are passed between them.
    """
    passed = []
    if actor is not None:
        passed.append(by_actor(steps, actor))
    if artifact is not None:
        passed.append(by_artifact(steps, artifact))
    if after is not None or before is not None:
        passed.append(by_time(steps, after or "", before or "9999-12-31T23:59:59Z"))
    out = steps
    for p in passed:
        out = out.join(p.select("path_id", "step_id"), ["path_id", "step_id"], "left_semi")
    return out


def where_unique(steps: DataFrame, actor: str | None = None, artifact: str | None = None, after: str | None = None, before: str | None = None) -> DataFrame:
    """where() for step ids that are unique in their path: one scan, no join."""
    out = steps
    if actor is not None:
        out = by_actor(out, actor)
    if artifact is not None:
        out = by_artifact(out, artifact)
    if after is not None or before is not None:
        out = by_time(out, after or "", before or "9999-12-31T23:59:59Z")
    return out


def blame(steps: DataFrame, noise: tuple[str, ...] = ("tool",)) -> DataFrame:
    """Steps that aren't formatting noise: by another kind of actor, or with a structural change."""
    kept = ~X.actor_type("actor").isin(*noise)
    if "change" in steps.columns:
        kept = kept | F.exists(F.map_values("change"), lambda c: c["structural"].isNotNull())
    return steps.where(kept)


def artifacts(steps: DataFrame) -> DataFrame:
    """Distinct (path_id, artifact)."""
    if "change" in steps.columns:
        return steps.select("path_id", F.explode(F.map_keys("change")).alias("artifact")).distinct()
    return steps.where("artifact is not null").select("path_id", "artifact").distinct()


def actors(steps: DataFrame) -> DataFrame:
    """Distinct (path_id, actor)."""
    return steps.select("path_id", "actor").distinct()


def first_definitions(defs: DataFrame, key: str, order: str) -> DataFrame:
    """Of several rows of a key the first by ``order``."""
    rest = [c for c in defs.columns if c not in (key, order)]
    return defs.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("__d")).select(key, "__d.*")


def resolve_actors(steps: DataFrame, definitions: DataFrame) -> DataFrame:
    """Steps with the display name of their actor: the defined name, else what follows the colon."""
    named = definitions.select("actor", F.col("name").alias("__name"))
    return steps.join(named, "actor", "left").withColumn("actor_name", F.coalesce("__name", X.actor_name("actor"))).drop("__name")


def merge(paths: DataFrame) -> DataFrame:
    """Rows of all paths under one graph id, made from their number; none is merged with another."""
    n = paths.agg(F.count("*").alias("__n"))
    return paths.crossJoin(F.broadcast(n)).withColumn("graph_id", F.concat(F.lit("graph-merged-"), F.col("__n").cast("string"))).drop("__n")


#: Of a revision with more steps than this the others are listed in parts.
PART = 1000


def correlate(steps: DataFrame) -> DataFrame:
    """(revision, path_id, step_id) of the steps whose revision occurs in several paths: a row a step, in place of a row a pair.

    Which steps a step goes with follows from the revision; add_refs() writes it
    out, pairs() lists it.
    """
    return same_change(steps).select("revision", "path_id", "step_id")


def pairs(hubs: DataFrame) -> DataFrame:
    """(revision, a_path, a_step, b_path, b_step): each two steps of different paths with one revision, once, from the lesser path id.

    As many rows as there are such pairs.  ``hubs`` are those of correlate().
    """
    side = lambda p: hubs.select("revision", F.col("path_id").alias(f"{p}_path"), F.col("step_id").alias(f"{p}_step"))
    return side("a").join(side("b"), "revision").where("a_path < b_path")


def _parts(hubs: DataFrame, *members: str) -> DataFrame:
    """(revision, part, parts, members): the different members of each revision in parts of bounded size."""
    sizes = hubs.groupBy("revision").agg(F.ceil(F.count("*") / PART).alias("parts"))
    dealt = hubs.join(sizes, "revision").withColumn("part", F.pmod(F.xxhash64(*members), F.col("parts")))
    return dealt.groupBy("revision", "parts", "part").agg(F.collect_set(F.struct(*members)).alias("members"))


def same_change(steps: DataFrame) -> DataFrame:
    """Steps whose revision occurs in more than one path, with the number of paths and the first of them."""
    shared = steps.where("revision is not null").groupBy("revision").agg(F.count_distinct("path_id").alias("n_paths"), F.min("path_id").alias("first_path")).where("n_paths > 1")
    return steps.join(shared, "revision")


def add_refs(steps: DataFrame, hubs: DataFrame) -> DataFrame:
    """Steps with a same-change reference to each step of another path with their revision; those that are there stay, so doing it twice changes nothing.

    ``hubs`` are those of correlate().  Steps meet the others of their revision
    in one shuffle by revision; only where there are too many for a row do the
    references come in parts and are put together by step.
    """
    kind = "array<struct<rel:string,href:string>>"
    none = F.array().cast(kind)
    href = lambda m: F.struct(F.lit("same-change").alias("rel"), F.concat(F.lit("path:"), m["path_id"], F.lit("/"), m["step_id"]).alias("href"))
    parts = _parts(hubs, "path_id", "step_id").withColumnRenamed("revision", "__revision")
    others = F.transform(F.filter("members", lambda m: m["path_id"] != F.col("path_id")), href)
    have = F.coalesce(F.col("refs"), none) if "refs" in steps.columns else none
    met = lambda rows, which: rows.join(parts.where(which), F.col("revision") == F.col("__revision"), "left")
    heavy = met(steps.select("revision", "path_id", "step_id"), "parts > 1").where("part is not null").groupBy(F.col("path_id").alias("__path"), F.col("step_id").alias("__step"), F.col("revision").alias("__heavy")).agg(F.flatten(F.collect_list(others)).alias("__many"))
    out = met(steps, "parts = 1").withColumn("__new", F.coalesce(others, none)).drop("__revision", "parts", "part", "members")
    out = out.join(heavy, (F.col("path_id") == F.col("__path")) & (F.col("step_id") == F.col("__step")) & (F.col("revision") == F.col("__heavy")), "left")
    new = F.array_sort(F.concat("__new", F.coalesce("__many", none)))
    return out.withColumn("refs", F.array_union(have, new)).drop("__new", "__path", "__step", "__heavy", "__many")


def base_steps(paths: DataFrame, steps: DataFrame) -> DataFrame:
    """(path_id, base_step): the step whose revision a path's base names: exactly, else by its first eight characters; of several the last.

    ``paths``: graph_id, path_id, base_ref; ``steps``: graph_id, path_id, path_pos, pos, step_id, revision.
    Both meet in one shuffle by graph and prefix.
    """
    none = F.lit(None).cast("string")
    bare = paths.where("base_ref is null").select("graph_id", "path_id", none.alias("base_step"))
    asked = paths.where("base_ref is not null").select("graph_id", "path_id", F.col("base_ref").alias("revision"), F.lit(True).alias("__asked"))
    known = steps.where("revision is not null").groupBy("graph_id", "revision").agg(F.max(F.struct("path_pos", "pos", "step_id")).alias("__at"))
    both = asked.unionByName(known, allowMissingColumns=True).withColumn("__short", X.prefix("revision", 8))
    exact = F.max("__at").over(Window.partitionBy("graph_id", "__short", "revision"))
    near = F.max("__at").over(Window.partitionBy("graph_id", "__short"))
    found = both.select("graph_id", "path_id", "__asked", F.coalesce(exact, near)["step_id"].alias("base_step")).where("__asked")
    return found.select("graph_id", "path_id", "base_step").unionByName(bare)


def related_paths(steps: DataFrame, hubs: DataFrame) -> DataFrame:
    """(path_id, rel, other) of paths that have a change in common; ``hubs`` are those of correlate().

    A path that an agent worked on produces one whose every step has a revision,
    and that one is produced-by it; where this isn't so, or is so both ways,
    each complements the other.

    Revisions that the same paths share give their pairs once.  Of a revision
    with many paths each part meets each other part in a row of its own.
    """
    kind = steps.groupBy("path_id").agg(F.max(F.startswith("actor", F.lit("agent:"))).alias("agent"), F.min(F.col("revision").isNotNull()).alias("vcs"))
    incidence = hubs.select("revision", "path_id").distinct().join(kind, "path_id")
    parts = _parts(incidence, "path_id", "agent", "vcs").withColumn("members", F.array_sort("members"))
    alone = parts.where("parts = 1").select("members").distinct().select("members", F.col("members").alias("others"))
    halves = lambda name: parts.where("parts > 1").select("revision", F.col("part").alias(f"__{name}"), F.col("members").alias(name))
    met = halves("members").join(halves("others"), "revision").where("__members <= __others").select("members", "others")
    each = alone.unionAll(met).select(F.explode("members").alias("x"), "others").select("x", F.explode("others").alias("y")).where("x.path_id <> y.path_id")
    found = each.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    forth, back = F.expr("a.agent and b.vcs"), F.expr("b.agent and a.vcs")
    rel = F.when(forth & ~back, "produces").when(back & ~forth, "produced-by").otherwise("complements")
    other = F.when(forth & ~back, "produced-by").when(back & ~forth, "produces").otherwise("complements")
    ways = found.select(F.explode(F.array(F.struct(F.col("a.path_id").alias("path_id"), rel.alias("rel"), F.col("b.path_id").alias("other")), F.struct(F.col("b.path_id").alias("path_id"), other.alias("rel"), F.col("a.path_id").alias("other")))).alias("w"))
    return ways.select("w.*")


def correlated_graphs(paths: DataFrame, hubs: DataFrame) -> DataFrame:
    """(graph_id, rel, href): the mark of each graph that has related paths, once; ``hubs`` are those of correlate()."""
    return paths.join(hubs.select("path_id").distinct(), "path_id", "left_semi").select("graph_id").distinct().withColumns({"rel": F.lit("correlates"), "href": F.lit("self")})


def by_priority(rows: DataFrame, key: str, name: str, order: tuple[str, ...], other: bool = False) -> DataFrame:
    """(key, name): of a key's names the one that stands first in ``order``; with ``other`` any name counts, those not in it last."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(name))
    place = F.when(rank > 0, rank).otherwise(len(order) + 1)
    some = rows if other else rows.where(F.col(name).isin(*order))
    return some.groupBy(key).agg(F.min_by(name, F.struct(place, F.col(name))).alias(name))


def heads_of(steps: DataFrame, *keys: str) -> DataFrame:
    """keys, n_steps and head (the last step) of each path."""
    return steps.groupBy(*keys).agg(F.count("*").alias("n_steps"), F.max_by("step_id", "pos").alias("head"))


def distinct_union(*parts: DataFrame) -> DataFrame:
    """The different rows of all parts; columns go by name."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def parent_steps(steps: DataFrame, edges: DataFrame, *columns: str) -> DataFrame:
    """edges with columns of the parent, named parent_<column>; edges to what is no step are left out."""
    known = steps.select("path_id", F.col("step_id").alias("parent"), *(F.col(c).alias(f"parent_{c}") for c in columns))
    return edges.join(known, ["path_id", "parent"])


def without(rows: DataFrame, others: DataFrame, *keys: str) -> DataFrame:
    """The different rows whose keys ``others`` doesn't have."""
    return rows.distinct().join(others, list(keys), "left_anti")
