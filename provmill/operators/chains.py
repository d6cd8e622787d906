"""Chains of session files: each file may continue one other."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provmill.operators.dag import shared_dir


def links(first_ids: DataFrame) -> DataFrame:
    """(pred, succ): a file whose first session id isn't its own name continues the file of that name.

    ``first_ids``: project, segment, session_id.  Of several files that continue
    one, the last by name counts.
    """
    found = first_ids.where("session_id <> '' and session_id <> segment")
    return found.groupBy(F.col("session_id").alias("pred")).agg(F.max("segment").alias("succ"))


def chains(segments: DataFrame, links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(head, segment, ord): each segment in its chain, counted from the head.

    ``segments``: segment; ``links``: pred, succ, at most one succ of each pred and
    one pred of each succ.  Pointers double their reach each round, so rounds
    grow with the logarithm of the longest chain.  A cycle is walked once, from
    its least segment.
    """
    shared_dir(segments.sparkSession)
    back = links.where("pred <> succ").select(F.col("succ").alias("segment"), F.col("pred").alias("to"))
    # (segment, to, steps): to is so many links before; done when it has no predecessor
    at = segments.select("segment").distinct().join(back, "segment", "left").select("segment", F.coalesce("to", "segment").alias("to"), F.when(F.col("to").isNull(), 0).otherwise(1).alias("steps"), F.least("segment", F.coalesce("to", "segment")).alias("least")).checkpoint()
    n = at.count()
    for _ in range(most_rounds):
        onward = at.select(F.col("segment").alias("to"), F.col("to").alias("__to"), F.col("steps").alias("__steps"), F.col("least").alias("__least"))
        now = at.join(onward, "to", "left").select("segment", F.coalesce("__to", "to").alias("to"), (F.col("steps").cast("long") + F.coalesce("__steps", F.lit(0))).alias("steps"), F.least("least", F.coalesce("__least", "least")).alias("least")).checkpoint()
        moved = now.join(at.select("segment", F.col("to").alias("__old")), "segment").where("`to` <> __old").limit(1).count()
        at = now
        if not moved:
            break
        if at.agg(F.max("steps")).first()[0] > 4 * n:
            break  # only cycles are left turning
    else:
        raise RuntimeError(f"chains not followed to their heads after {most_rounds} rounds")
    ends = at.join(back.select(F.col("segment").alias("to"), F.lit(True).alias("turns")), "to", "left")
    plain = ends.where("turns is null").select(F.col("to").alias("head"), "segment", F.col("steps").alias("ord"))
    cyclic = ends.where("turns").select("segment", "least")
    if cyclic.isEmpty():
        return plain
    loops = cyclic.join(links.select(F.col("pred").alias("segment"), "succ"), "segment").select(F.col("least").alias("head"), "segment", "succ")

    def walk(pdf):
        after = dict(zip(pdf["segment"], pdf["succ"], strict=True))
        out, node = {}, pdf["head"].iloc[0]
        while node is not None and node not in out:
            out[node] = len(out)
            node = after.get(node)
        import pandas as pd

        return pd.DataFrame({"head": pdf["head"].iloc[0], "segment": list(out), "ord": range(len(out))})

    return plain.unionByName(loops.groupBy("head").applyInPandas(walk, "head string, segment string, ord long"))


def heads(segments: DataFrame, links: DataFrame) -> DataFrame:
    """Segments that continue no other."""
    return segments.join(links.select(F.col("succ").alias("segment")), "segment", "left_anti")


def head_for(segment: str, found: DataFrame) -> DataFrame:
    """(head) of the chain that a segment is in.  ``found`` are chains()."""
    return found.where(F.col("segment") == segment).select("head")


def successor_of(segment: str, links: DataFrame) -> DataFrame:
    """(succ): the segment that continues this one, if there is one."""
    return links.where(F.col("pred") == segment).select("succ")


def with_neighbours(segments: DataFrame, links: DataFrame) -> DataFrame:
    """Segments with succ (what continues them) and is_successor (whether they continue another)."""
    out = segments.join(links.select(F.col("pred").alias("segment"), "succ"), "segment", "left")
    return out.join(links.select(F.col("succ").alias("segment"), F.lit(True).alias("__is")).distinct(), "segment", "left").withColumn("is_successor", F.coalesce("__is", F.lit(False))).drop("__is")
