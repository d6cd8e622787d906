"""Watching conversations: events with state, chains as they grow, the delta beside the whole.

The state of a stream lies in its checkpoint; these operators need the RocksDB
state store (``spark.sql.streaming.stateStore.providerClass``).

Time is the time of arrival: a batch's own.  So no entry is ever late, however
old its own time is, and a timer is due when a later batch arrives.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from provmill.streaming import tail

#: The text of the progress event that tells of a rotation.
ROTATED = "session_rotated"
#: The state store that these operators need (fixed value).
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _arriving(entries: DataFrame) -> DataFrame:
    stream = tail.foldable(entries)
    if stream.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != STORE:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {STORE}")
    return stream.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", "0 seconds")


#: So many uuids, and so many turns with open calls, of a segment lie in one value, which is read and written once a batch; more go to a map, where each is looked up by itself.
HELD = 1000


class _Held:
    """What is known of a segment: the uuids seen, and its open calls with, by id, their turns, the oldest first, and when each expires.

    One trip to the state store brings all of a segment that is no longer than
    ``HELD``, and one takes it back, where a trip for each entry took most of a
    batch's time.  What is longer goes to the maps, an entry once.
    """

    def __init__(self, value, seen, calls, patience: int | None, timer: Callable[[int], None]) -> None:
        self.value, self.seen_map, self.calls_map, self.patience, self.timer, self.now = value, seen, calls, patience, timer, 0
        self.timers: set[int] = set()
        held = value.get()
        if held is None:  # new, or of a stream that began when there was nothing but the maps
            held = ([], seen.exists(), [], [], [], calls.exists())
        uuids, self.more, names, turns, until, self.more_calls = held
        self.uuids, self.changed = dict.fromkeys(uuids), False
        self.calls: dict[str, list[tuple[str, int]]] = {}
        for name, turn, due in zip(names, turns, until, strict=True):
            self.calls.setdefault(name, []).append((turn, due))

    def see(self, uuid: str) -> bool:
        """Whether it is new; from now on it isn't."""
        if uuid in self.uuids or self.more and self.seen_map.containsKey((uuid,)):
            return False
        self.uuids[uuid] = None
        self.changed = True
        return True

    def open(self, call: str, turn: str) -> None:
        due = self.now + self.patience if self.patience is not None else 1 << 62
        self.calls.setdefault(call, []).append((turn, due))
        self.changed = True
        if self.patience is not None and due not in self.timers:
            self.timers.add(due)
            self.timer(due)

    def close(self, call: str) -> str | None:
        if call in self.calls:  # newer than what is in the map
            turns = self.calls[call]
            turn, _ = turns.pop()
            if not turns:
                del self.calls[call]
            self.changed = True
            return turn
        if not (self.more_calls and self.calls_map.containsKey((call,))):
            return None
        turns, until = self.calls_map.getValue((call,))
        self._keep(call, list(zip(turns, until, strict=True))[:-1])
        return turns[-1]

    def expired(self, due: int) -> list[tuple[str, str]]:
        """(call, turn) of those that are due, which are open no more."""
        stored = [(call, list(zip(turns, until, strict=True))) for (call,), (turns, until) in list(self.calls_map.iterator())] if self.more_calls else []
        out = []
        for call, turns in stored:
            if any(u <= due for _, u in turns):
                out += [(call, t) for t, u in turns if u <= due]
                self._keep(call, [(t, u) for t, u in turns if u > due])
        for call, turns in list(self.calls.items()):
            out += [(call, t) for t, u in turns if u <= due]
            self.calls[call] = [(t, u) for t, u in turns if u > due]
            if not self.calls[call]:
                del self.calls[call]
        self.changed |= bool(out)
        return out

    def _keep(self, call: str, left: list[tuple[str, int]]) -> None:
        if left:
            self.calls_map.updateValue((call,), ([t for t, _ in left], [u for _, u in left]))
        else:
            self.calls_map.removeKey((call,))

    def store(self) -> None:
        if not self.changed:
            return
        if len(self.uuids) > HELD:
            for uuid in self.uuids:
                self.seen_map.updateValue((uuid,), (1,))
            self.uuids, self.more = {}, True
        if sum(map(len, self.calls.values())) > HELD:
            for call, turns in self.calls.items():
                before = self.calls_map.getValue((call,)) if self.more_calls and self.calls_map.containsKey((call,)) else ([], [])
                self._keep(call, [*zip(*before, strict=True), *turns])
            self.calls, self.more_calls = {}, True
        flat = [(call, turn, due) for call, turns in self.calls.items() for turn, due in turns]
        self.value.update((list(self.uuids), self.more, [c for c, _, _ in flat], [t for _, t, _ in flat], [u for _, _, u in flat], self.more_calls))


class _Watch(StatefulProcessor):
    """Of one segment."""

    def __init__(self, patience: int | None, role: str | None, bridges: bool) -> None:
        self.patience, self.role, self.bridges = patience, role, bridges

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("held", "uuids array<string>, more boolean, calls array<string>, turns array<string>, until array<long>, more_calls boolean")
        self.seen = handle.getMapState("seen", "uuid string", "times int")
        self.calls = handle.getMapState("calls", "call string", "turns array<string>, until array<long>")
        self.timer = handle.registerTimer

    def _held(self) -> _Held:
        return _Held(self.value, self.seen, self.calls, self.patience, self.timer)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        held = self._held()
        for uuid in initialState["uuid"]:
            held.see(uuid)
        held.store()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        whole = [r for part in rows for r in part.to_dict("records")]
        whole.sort(key=lambda r: (r["file"], r["line_no"]))
        held, out = self._held(), []
        for r in whole:
            if not held.see(r["uuid"]):
                continue
            if not self.bridges and r["session_id"] and r["session_id"] != key[1]:
                continue
            held.now = int(r["arrived"].timestamp() * 1000)
            made = list(tail.fold(key, r, held))
            out += made if self.role is None or r["role"] == self.role else []
        held.store()
        if out:
            yield tail.frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        gone = held.expired(expiredTimerInfo.getExpiryTimeInMs())
        held.store()
        yield tail.frame([(*key, "call_expired", turn, None, None, call, None, None, None, None) for call, turn in gone])

    def close(self) -> None:
        pass


def watch(entries: DataFrame, patience_ms: int | None = None, role: str | None = None, bridges: bool = False, seen: DataFrame | None = None) -> DataFrame:
    """Events of a stream of entries, each uuid of a segment once.

    ``turn``; ``turn_updated``: a result that came after its call, in the same
    batch or any later one; ``progress`` with its data; ``call_expired``: a call
    without a result once a batch arrives more than ``patience_ms`` after the
    one that brought it (without it calls stay open for good, and a result that
    comes after this event is dropped).

    ``seen`` (project, segment, uuid): entries that count as seen from the
    start.  Entries of another ``role``, and those that bridge from another
    session (unless ``bridges``), don't come out but count as seen.
    """
    initial = None if seen is None else seen.select("project", "segment", "uuid").groupBy("project", "segment")
    return _arriving(entries).groupBy("project", "segment").transformWithStateInPandas(_Watch(patience_ms, role, bridges), tail.EVENT, "append", "eventTime", initialState=initial)


# chains


class _First(StatefulProcessor):
    """The first session id of a segment, once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.told = handle.getValueState("told", "session_id string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        whole = pd.concat(list(rows))
        if not self.told.exists():
            named = whole[whole["session_id"].fillna("") != ""].sort_values(["file", "line_no"])
            session = named["session_id"].iloc[0] if len(named) else ""
            if session:
                self.told.update((session,))
                yield pd.DataFrame({"project": [key[0]], "segment": [key[1]], "session_id": [session]})

    def close(self) -> None:
        pass


class _Chains(StatefulProcessor):
    """The chains of one project.  A segment has at most one that it continues; of several that continue one, the last by name counts."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.after = handle.getMapState("after", "segment string", "next string")
        self.place = handle.getMapState("place", "segment string", "head string, ord long")
        self.waiting = handle.getMapState("waiting", "segment string", "followers array<string>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.moved: dict[str, tuple[str, int]] = {}
        rotations: list[tuple[str, str]] = []
        arrived = pd.concat(list(rows)).drop_duplicates("segment").sort_values("segment")
        for r in arrived.to_dict("records"):
            name, before = r["segment"], r["session_id"]
            self._put(name, name, 0)
            if before != name:
                if self.place.containsKey((before,)):
                    rotations += self._link(before, name)
                else:
                    followers = self.waiting.getValue((before,))[0] if self.waiting.containsKey((before,)) else []
                    self.waiting.updateValue((before,), ([*followers, name],))
            if self.waiting.containsKey((name,)):
                for follower in self.waiting.getValue((name,))[0]:
                    rotations += self._link(name, follower)
                self.waiting.removeKey((name,))
        progress = [(key[0], a, "progress", None, None, ROTATED, None, None, None, json.dumps({"from": a, "to": b}), -1) for a, b in rotations]
        chained = [(key[0], s, "chained", None, None, head, None, None, None, json.dumps({"head": head, "ord": n}), -1) for s, (head, n) in self.moved.items()]
        yield tail.frame(progress + chained)

    def _put(self, segment: str, head: str, ord: int) -> None:
        self.place.updateValue((segment,), (head, ord))
        self.moved[segment] = head, ord

    def _next(self, segment: str) -> str | None:
        return self.after.getValue((segment,))[0] if self.after.containsKey((segment,)) else None

    def _lay(self, segment: str, head: str, ord: int) -> None:
        """``segment`` and all that follow it go to ``head``."""
        at = segment
        while at is not None:
            self._put(at, head, ord)
            at, ord = self._next(at), ord + 1
            if at == segment:
                break

    def _link(self, before: str, name: str) -> list[tuple[str, str]]:
        other = self._next(before)
        if other is not None and other > name:
            return []
        if other is not None:  # what followed so far starts a chain of its own
            self.after.removeKey((before,))
            self._lay(other, other, 0)
        self.after.updateValue((before,), (name,))
        head, ord = self.place.getValue((before,))
        if head == name:  # a ring is laid from its least segment
            ring, at = [name], self._next(name)
            while at is not None and at != name:
                ring.append(at)
                at = self._next(at)
            self._lay(min(ring), min(ring), 0)
        else:
            self._lay(name, head, ord + 1)
        return [(before, name)]

    def close(self) -> None:
        pass


def chain_events(entries: DataFrame) -> DataFrame:
    """Of a stream of entries, as segments of a project turn out to continue each other:

    ``progress`` named session_rotated (data: from, to), once both segments are
    there, each pair once; and ``chained`` (data: head, ord) for each segment
    whose place in a chain is new, the segment itself at first.  Segments may
    arrive in any order.
    """
    first = _arriving(entries).groupBy("project", "segment").transformWithStateInPandas(_First(), "project string, segment string, session_id string", "append", "none")
    return first.groupBy("project").transformWithStateInPandas(_Chains(), tail.EVENT, "append", "none")


def places(events: DataFrame, order: str = "batch") -> DataFrame:
    """(project, segment, head, ord) by the latest ``chained`` event of each segment."""
    rows = events.where("event = 'chained'")
    last = rows.groupBy("project", "segment").agg(F.max_by("data", order).alias("data"))
    return last.select("project", "segment", F.get_json_object("data", "$.head").alias("head"), F.get_json_object("data", "$.ord").cast("long").alias("ord"))


def in_order(events: DataFrame) -> DataFrame:
    """A batch's events, rotations first."""
    return events.orderBy(F.col("line_no").isNull(), F.when(F.col("line_no") >= 0, 1).otherwise(0), "project", "segment", "line_no")


# the delta and the whole


class Kept:
    """Rows of a stream in a folder, a sub-folder for each batch.

    A batch that is repeated replaces itself, so what is kept doesn't depend on
    how often it ran; a stream that starts over replaces its batches one by one.
    """

    def __init__(self, folder: str) -> None:
        self.folder = folder.rstrip("/")

    def save(self, batch: DataFrame, batch_id: int) -> None:
        batch.sortWithinPartitions("project", "segment").write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")

    def through(self, spark, schema, batch_id: int) -> DataFrame:
        """All rows up to a batch, with ``batch``."""
        return spark.read.schema(schema.add("batch", "long") if "batch" not in schema.names else schema).option("basePath", self.folder).parquet(self.folder).where(F.col("batch") <= batch_id)

    def delta(self, spark, schema, batch_id: int) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{self.folder}/batch={batch_id}")


def with_whole(stream: DataFrame, folder: str, handle: Callable[[DataFrame, DataFrame, int], None]) -> DataStreamWriter:
    """A writer that calls ``handle(delta, whole, batch)`` for each batch: its rows, and all rows so far of the segments that it touches.

    Rows are kept in ``folder`` (shared by all machines) before ``handle`` runs,
    whose work has to bear repetition.  A batch without rows has an empty delta
    and whole.
    """
    from copy import deepcopy

    kept, schema = Kept(folder), stream.schema

    def each(batch: DataFrame, batch_id: int) -> None:
        kept.save(batch, batch_id)
        spark = batch.sparkSession
        delta = kept.delta(spark, schema, batch_id)
        touched = delta.select("project", "segment").distinct()
        handle(delta, kept.through(spark, deepcopy(schema), batch_id).join(touched, ["project", "segment"], "left_semi"), batch_id)

    return stream.writeStream.foreachBatch(each)
