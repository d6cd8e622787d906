"""Merkle manifest of a dataset: a root over all rows, and each row's path to it.

Rows of a group, in order, are the leaves of a tree of ``ARITY`` children; the
groups' roots, in order, are the leaves of one more tree.  What is stored of a
parent is its preimage, the concatenated digests of its children.  A leaf joins
the preimages of its ancestors: cutting its own 64 characters out of one leaves
the siblings, putting another digest in their place and hashing folds a step up.

Preimages lie in pages.  A page holds ``LEVELS`` levels of parents above 27
neighbouring nodes, and, once its own ancestors are known, their preimages too,
so that a leaf needs one join whatever the height.  Pages are built stride by
stride: each has a 27th of the rows of the one below.

Order within a group comes from range partitions, not from a window over the
group, so a group that holds most rows is dealt over many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provmill.llm.common import written

#: Children of a parent, levels of parents in a page, characters of a digest.
ARITY, LEVELS, DIGEST = 3, 3, 64
PAGE = ARITY**LEVELS

_STEPS = "array<struct<preimage:string,slot:int>>"


def digest(column: Column) -> Column:
    """Lower-case hex SHA-256."""
    return F.sha2(column, 256)


def leaf(*values: Column) -> Column:
    """Digest of values, each as its UTF-8 byte count, a colon and its text, or ``-`` for null."""
    as_text = [v.cast("string") for v in values]
    return digest(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in as_text)))


def numbered(df: DataFrame, group: str, *order: str, kind: str = "numbered") -> DataFrame:
    """``df`` with ``i``, a row's place from 0 among its ``group`` (never null) in ``order``, and ``n``, its group's rows.

    Rows that agree in ``order`` are numbered as they come.
    """
    keys = [F.col(group), *(F.col(c).asc_nulls_first() for c in order), F.col("__tie")]
    in_order = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = written(in_order.select(*df.columns, F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at")), kind)
    runs = placed.groupBy(group, "__part").agg(F.count("*").alias("__rows"), F.min("__at").alias("__first"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("__rows").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col(group), "__part", (before - F.col("__first")).alias("__shift"), F.sum("__rows").over(whole).alias("n"))
    return placed.join(runs, [group, "__part"]).select(*df.columns, (F.col("__at") + F.col("__shift")).alias("i"), "n")


def _pages(nodes: DataFrame) -> DataFrame:
    """(g, page, n, levels, hash): preimages of each level above 27 neighbours of (g, i, n, hash), and the hash on top.

    A level is there only if more than one of the group's ``n`` nodes remained below it.
    """
    page = nodes.groupBy("g", F.floor(F.col("i") / PAGE).alias("page")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "hash"))).alias("__below"))
    page = page.select("g", "page", "n", F.col("__below.hash").alias("__h0"))
    for level in range(LEVELS):
        below = F.col(f"__h{level}")
        parents = F.transform(F.sequence(F.lit(0), F.floor((F.size(below) - 1) / ARITY).cast("int")), lambda k: F.array_join(F.slice(below, k * ARITY + 1, ARITY), ""))  # noqa: B023
        page = page.withColumn(f"__p{level}", F.when(F.col("n") > ARITY**level, parents).otherwise(F.array().cast("array<string>")))
        page = page.withColumn(f"__h{level + 1}", F.when(F.col("n") > ARITY**level, F.transform(f"__p{level}", digest)).otherwise(below))
    return page.select("g", "page", "n", F.array(*(F.col(f"__p{level}") for level in range(LEVELS))).alias("levels"), F.element_at(f"__h{LEVELS}", 1).alias("hash"))


def _steps(levels: Column, i: Column) -> Column:
    """[(preimage, slot)] from node ``i``'s parent up, within its page."""
    at = (i % PAGE).cast("int")
    each = F.transform(
        levels,
        lambda parents, level: F.when(
            F.size(parents) > 0,
            F.struct(
                F.get(parents, F.floor(at / F.pow(F.lit(float(ARITY)), level + 1)).cast("int")).alias("preimage"),
                (F.floor(at / F.pow(F.lit(float(ARITY)), level)) % ARITY).cast("int").alias("slot"),
            ),
        ),
    )
    return F.filter(each, lambda s: s.isNotNull())


def _built(nodes: DataFrame, kind: str) -> tuple[list[DataFrame], DataFrame]:
    """The pages of each stride, from the lowest, and (g, hash) of each group's root."""
    strides, roots = [], []
    while True:
        pages = written(_pages(nodes), f"{kind}-{len(strides)}")
        strides.append(pages)
        roots.append(pages.where(F.col("n") <= PAGE).select("g", "hash"))
        higher = pages.where(F.col("n") > PAGE)
        if higher.isEmpty():
            return strides, reduce(DataFrame.unionAll, roots)
        nodes = higher.select("g", F.col("page").alias("i"), F.ceil(F.col("n") / PAGE).alias("n"), "hash")


def _with_ancestors(strides: list[DataFrame], above: DataFrame | None, kind: str) -> DataFrame:
    """The lowest pages with ``above``, the steps from their top to the root, and what else ``above`` carries by group.

    ``above`` (g, steps, ...) continues beyond the groups' roots.
    """
    done = None
    for k in reversed(range(len(strides))):
        pages = strides[k].select("g", "page", "n", "levels")
        tops = pages.where(F.col("n") <= PAGE)
        tops = tops.withColumn("steps", F.array().cast(_STEPS)) if above is None else tops.join(above, "g")
        if done is not None:
            names = [c for c in done.columns if c not in ("g", "page", "n", "levels", "steps")]
            up = done.select("g", F.col("page").alias("__up"), F.col("levels").alias("__levels"), F.col("steps").alias("__steps"), *names)
            lower = pages.where(F.col("n") > PAGE).withColumn("__up", F.floor(F.col("page") / PAGE)).join(up, ["g", "__up"])
            lower = lower.withColumn("steps", F.concat(_steps(F.col("__levels"), F.col("page")), F.col("__steps"))).drop("__up", "__levels", "__steps")
            tops = tops.select(*lower.columns).unionAll(lower)
        done = written(tops, f"{kind}-paths-{k}") if k else tops
    return done


@dataclass
class Manifest:
    """``leaves``: the rows with their group ``g``, place ``i`` and ``leaf``; ``pages``: preimages with their ancestors, ``subroot`` and ``root``."""

    leaves: DataFrame
    pages: DataFrame

    def paths(self) -> DataFrame:
        """The leaves with ``steps``, [(preimage, slot)] from the leaf's parent to the root, ``subroot`` and ``root``."""
        own = self.leaves.withColumn("page", F.floor(F.col("i") / PAGE))
        pages = self.pages.select("g", "page", "levels", F.col("steps").alias("__above"), "subroot", "root")
        joined = own.join(pages, ["g", "page"])
        return joined.withColumn("steps", F.concat(_steps(F.col("levels"), F.col("i")), F.col("__above"))).drop("levels", "__above", "page")


def manifest(rows: DataFrame, group: str = "source", order: tuple[str, ...] = ("doc_id",), leaf: str = "leaf") -> Manifest:
    """Trees over ``rows``, whose ``leaf`` is each row's digest in hex.

    Groups are ordered by their text, bytewise, null first; rows of a group by
    ``order``, nulls first, then by ``leaf``.  A group of one row is its own
    subroot, a single group its own root.  Without rows there is nothing.
    Repeated rows are leaves of their own.  Columns named g, i, n, __part, __at
    or __tie mustn't be there.
    """
    keyed = rows.withColumn("g", F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")))
    leaves = numbered(keyed, "g", *order, leaf, kind="leaves")
    strides, roots = _built(leaves.select("g", "i", "n", F.col(leaf).alias("hash")), "tree")
    # the tree over the groups' roots: one group named "", whose members are the groups
    members = numbered(written(roots.select(F.lit("").alias("all"), F.col("g").alias("member"), "hash"), "subroots"), "all", "member", kind="groups")
    top, root = _built(members.select(F.col("all").alias("g"), "i", "n", "hash"), "top")
    whole = root.first()  # one row, none without leaves
    groups = members.withColumn("page", F.floor(F.col("i") / PAGE)).join(_with_ancestors(top, None, "top").drop("n", "g"), "page")
    groups = groups.select(F.col("member").alias("g"), F.concat(_steps(F.col("levels"), F.col("i")), F.col("steps")).alias("steps"), F.col("hash").alias("subroot"), F.lit(whole and whole.hash).cast("string").alias("root"))
    return Manifest(leaves, _with_ancestors(strides, written(groups, "group-paths"), "tree"))


def excised(steps: Column) -> Column:
    """The siblings on a path, level by level: each preimage without the path's own slot."""
    cut = lambda s: F.concat(F.substring(s["preimage"], F.lit(1), s["slot"] * DIGEST), F.substring(s["preimage"], s["slot"] * DIGEST + DIGEST + 1, F.length(s["preimage"])))
    return F.array_join(F.transform(steps, cut), "")


def folded(leaf: Column, steps: Column) -> Column:
    """The root that ``leaf`` and the siblings on its path give."""
    return F.aggregate(steps, leaf, lambda hash, s: digest(F.overlay(s["preimage"], hash, s["slot"] * DIGEST + 1)))


def verified(built: Manifest, id: str = "doc_id", leaf: str = "leaf", claimed: str = "claimed") -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of each leaf.

    ``claimed`` is the digest of the row as it is now, null where that can only
    be the leaf; it is folded with the siblings of the manifest.
    """
    paths = built.paths()
    out = paths.select(id, leaf, "subroot", "root", digest(excised(F.col("steps"))).alias("proof_sha256"), folded(F.coalesce(F.col(claimed), F.col(leaf)), F.col("steps")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
