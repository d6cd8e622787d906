"""Live conversation logs as streams.

A stream's checkpoint holds what was read and what was seen; starting with a
new checkpoint starts over.  Rotation needs no step of its own: all segments of
a folder are one stream, and chains are resolved on what has arrived.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provmill.sources import logs


def entries(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Entries of files as they arrive in ``folder``.

    Files are read once, when they appear, by Spark's own reader; logs that
    grow in place are read by growing.stream().
    """
    reader = spark.readStream.option("wholetext", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    raw = reader.text(folder).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("file_size"))
    split = raw.select("file", "file_size", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    at = lambda i: F.element_at(F.split("file", "/"), i)
    named = split.select(at(-2).alias("project"), F.regexp_replace(at(-1), r"(\.part\d+)?\.jsonl$", "").alias("segment"), "file", "file_size", "line_no", "line")
    return logs.entries(named)


def first_seen(stream: DataFrame, role: str | None = None, within: str | None = None) -> DataFrame:
    """Entries whose uuid wasn't seen before; those of another role count as seen but don't come out.

    State grows with the number of uuids; ``within`` (a duration over column at)
    bounds it.
    """
    new = stream.withWatermark("at", within).dropDuplicatesWithinWatermark(["uuid"]) if within else stream.dropDuplicates(["uuid"])
    return new if role is None else new.where(F.col("role") == role)


EVENT = "project string, segment string, event string, uuid string, role string, text string, call_id string, result string, is_error boolean, data string, line_no long"


def progress_data() -> Column:
    """What a progress event says: uuid, timestamp, and under ``extra`` the fields that the entry has besides."""
    return F.to_json(F.struct("uuid", F.col("ts").alias("timestamp"), "extra"))


def foldable(entries: DataFrame) -> DataFrame:
    """What fold() reads."""
    return entries.select("project", "segment", "file", F.col("line_no").cast("long").alias("line_no"), "uuid", "type", "session_id", "has_message", "role", "text", "tool_uses", "tool_results", progress_data().alias("data"))


def fold(key: tuple, r: dict, calls) -> Iterator[tuple]:
    """An entry's events: a turn, updates of earlier turns by its results, or progress.

    ``calls`` has, by id, the turns whose call is open, the oldest first; a
    result goes to the newest.
    """
    results = list(r["tool_results"]) if r["tool_results"] is not None else []
    event = lambda kind, *rest, data=None: (*key, kind, *rest, data, int(r["line_no"]))
    if not r["has_message"]:
        yield event("progress", r["uuid"], None, r["type"], None, None, None, data=r["data"])
    elif r["role"] == "user" and not r["text"] and results:
        for x in results:
            if turn := calls.close(x["id"]):
                yield event("turn_updated", turn, None, None, x["id"], x["content"], bool(x["is_error"]))
    else:
        answered = {x["id"] for x in results}
        for u in r["tool_uses"] if r["tool_uses"] is not None else []:
            if u["id"] not in answered:
                calls.open(u["id"], r["uuid"])
        yield event("turn", r["uuid"], r["role"], r["text"], None, None, None)


class OpenCalls:
    """Open calls in memory."""

    def __init__(self) -> None:
        self.turns: dict[str, list[str]] = {}

    def open(self, call: str, turn: str) -> None:
        self.turns.setdefault(call, []).append(turn)

    def close(self, call: str) -> str | None:
        turns = self.turns.get(call)
        if not turns:
            return None
        turn = turns.pop()
        if not turns:
            del self.turns[call]
        return turn


def frame(events: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(events, columns=[c.split()[0] for c in EVENT.split(", ")])


def events(entries: DataFrame) -> DataFrame:
    """Events of entries that are all there, segment by segment in order of lines; of a segment only the open calls are held."""
    order = ["project", "segment", "file", "line_no"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, calls = None, OpenCalls()
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                if (r["project"], r["segment"]) != key:
                    key, calls = (r["project"], r["segment"]), OpenCalls()
                out += fold(key, r, calls)
            yield frame(out)

    return foldable(entries).repartition("project", "segment").sortWithinPartitions(*order).mapInPandas(run, EVENT)


def as_turn(rows: DataFrame) -> DataFrame:
    """Events that carry a turn: new ones and updates."""
    return rows.where(F.col("event").isin("turn", "turn_updated"))


def as_progress(rows: DataFrame) -> DataFrame:
    """(project, segment, kind, data) of progress events; data is JSON."""
    return rows.where("event = 'progress'").select("project", "segment", F.col("text").alias("kind"), "data")


def is_update() -> Column:
    return F.col("event") == "turn_updated"


def turn_id() -> Column:
    """The turn of an event that carries one, else null."""
    return F.when(F.col("event").isin("turn", "turn_updated"), F.col("uuid"))


def rotations(first_ids: DataFrame) -> DataFrame:
    """(project, from_segment, to_segment) of segments that continue another, as progress events."""
    return first_ids.where("session_id <> '' and session_id <> segment").select("project", F.col("session_id").alias("from_segment"), F.col("segment").alias("to_segment"))


def rotation_events(stream: DataFrame) -> DataFrame:
    """rotations() of a stream of entries, each once, when the first entry that carries another segment's id arrives; chains of several hops come hop by hop."""
    return rotations(stream.select("project", "segment", "session_id").where("session_id <> segment").dropDuplicates(["project", "segment"]))


# polls without a stream: what was seen is a table (uuid)


def mark_seen(seen: DataFrame | None, entries: DataFrame) -> DataFrame:
    """What was seen, and the entries besides."""
    new = entries.select("uuid").distinct()
    return new if seen is None else seen.unionByName(new).distinct()


def seen_count(seen: DataFrame) -> int:
    return seen.count()


def poll(entries: DataFrame, seen: DataFrame | None = None, role: str | None = None) -> DataFrame:
    """The entries that weren't seen before, the first of each uuid; of one role if that is given.

    ``entries`` are whole conversations, so they are also the full state beside
    this delta.  Entries of other roles don't come out; mark_seen() counts them.
    """
    first = Window.partitionBy("uuid").orderBy("segment", "line_no")
    new = entries if seen is None else entries.join(seen, "uuid", "left_anti")
    once = new.withColumn("__k", F.row_number().over(first)).where("__k = 1").drop("__k")
    return once if role is None else once.where(F.col("role") == role)
