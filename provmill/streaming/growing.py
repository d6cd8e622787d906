"""Log files that grow in place, read by byte offsets.

    spark.dataSource.register(GrowingLogs)
    spark.readStream.format("growing_logs").option("path", "/logs/projects/*/*.jsonl").option("state", "/shared/tail").load()

How far each file was read lies in the folder ``state``, a small file for each
batch with the files that changed, so a stream's own offset is two words
however many files there are.  A trigger looks at sizes and times of files and
opens only those that changed.  A batch takes at most ``maxBytes``, the rest
waits; it reads each file in ranges, so that a large file is dealt out to
several tasks; many small ones are read by one.

A last line without its end stays for the next time.  A file that has become
shorter gives nothing and goes on from its new end; one whose beginning isn't
what it was, and that isn't shorter, is another file and is read from its start.

The files have to be under the same path on all machines (a mount), ``state``
where the driver finds it again; for stores that only Spark's own readers reach,
tail.entries() reads files as they appear.
"""

from __future__ import annotations

import bisect
import glob
import json
import os
import uuid
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "project string, segment string, file string, line_no long, line string"
#: Bytes of a range.
RANGE_BYTES = 64 << 20


class Range(InputPartition):
    """A file's lines that begin in [start, stop); ``whole``: start is the beginning of a line."""

    def __init__(self, file: str, start: int, stop: int, whole: bool) -> None:
        self.file, self.start, self.stop, self.whole = file, start, stop, whole


#: Files of which a task reads ranges one after the other, as a task for each of many small files takes longer to start than to run.
FILES_IN_A_TASK = 256


class Ranges(InputPartition):
    """Ranges that one task reads."""

    def __init__(self, parts: list[Range]) -> None:
        self.parts = parts


def dealt(parts: Iterable[Range], size: int = RANGE_BYTES) -> list[Ranges]:
    """Ranges in their order, as many to a task as come to ``size`` bytes and FILES_IN_A_TASK."""
    out, left = [], 0
    for part in parts:
        length = part.stop - part.start
        if not out or length > left or len(out[-1].parts) >= FILES_IN_A_TASK:
            out.append(Ranges([]))
            left = size
        out[-1].parts.append(part)
        left -= length
    return out


def line_end(file: str, upto: int | None = None) -> int:
    """Where the last whole line ends, of those that end at ``upto`` or before."""
    with open(file, "rb") as f:
        at = f.seek(0, os.SEEK_END)
        at = at if upto is None else min(at, upto)
        while at:
            back = max(0, at - 65_536)
            f.seek(back)
            found = f.read(at - back).rfind(b"\n")
            if found >= 0:
                return back + found + 1
            at = back
    return 0


def next_line_end(file: str, start: int) -> int:
    """Where the line at ``start`` ends; ``start`` if it has no end yet."""
    with open(file, "rb") as f:
        f.seek(start)
        line = f.readline()
    return start + len(line) if line.endswith(b"\n") else start


def beginning(file: str, length: int) -> int:
    """A fingerprint of a file's first bytes."""
    with open(file, "rb") as f:
        return zlib.crc32(f.read(length))


def ranges(file: str, start: int, stop: int, size: int = RANGE_BYTES) -> list[Range]:
    return [Range(file, a, min(a + size, stop), a == start) for a in range(start, stop, size)]


def read_range(part: Range) -> Iterator[tuple[str, str, str, int, str]]:
    """Lines of a range with the offset each begins at; blank ones are left out."""
    folder, name = os.path.split(part.file)
    segment = name.removesuffix(".jsonl")
    with open(part.file, "rb") as f:
        at = part.start
        if not part.whole:  # the line that begins before the range belongs to the range before
            f.seek(at - 1)
            at += len(f.readline()) - 1
        f.seek(at)
        while at < part.stop:
            line = f.readline()
            if not line.endswith(b"\n"):
                return
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text.strip():
                yield os.path.basename(folder), segment, part.file, at, text
            at += len(line)


class _Batch(DataSourceReader):
    """All whole lines that are there."""

    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size

    def partitions(self) -> list[Ranges]:
        return dealt((r for file in sorted(glob.glob(self.path)) for r in ranges(file, 0, line_end(file), self.size)), self.size)

    def read(self, partition: Ranges) -> Iterator[tuple]:
        for part in partition.parts:
            yield from read_range(part)


#: Bytes of a file's beginning that tell whether it is still the same file; batches between two files of state that list all.
PRINT_BYTES, SNAPSHOT = 256, 50


class Positions:
    """How far files were read, by version; each version's file lists what changed, every SNAPSHOT-th also all."""

    def __init__(self, folder: str) -> None:
        self.folder = folder
        self.version = 0
        self.known: dict[str, list[int]] = {}  # file: [read up to, size, time, length of the fingerprint, fingerprint]

    def _file(self, version: int, kind: str) -> str:
        return f"{self.folder}/{version:012d}.{kind}"

    def load(self, version: int) -> None:
        """What was known at a version."""
        self.version, self.known = version, {}
        full = [v for v in range(version - version % SNAPSHOT, -1, -SNAPSHOT) if os.path.exists(self._file(v, "all"))][:1]
        if full:
            with open(self._file(full[0], "all")) as f:
                self.known = json.load(f)
        for v in range(full[0] + 1 if full else 1, version + 1):
            self.known.update({file: x["known"] for file, x in self.changes(v).items()})

    def newest(self) -> int:
        names = os.listdir(self.folder) if os.path.isdir(self.folder) else []
        return max((int(n.split(".")[0]) for n in names if n.endswith(".new")), default=0)

    def changes(self, version: int) -> dict[str, dict]:
        with open(self._file(version, "new")) as f:
            return json.load(f)

    def save(self, changes: dict[str, dict]) -> None:
        os.makedirs(self.folder, exist_ok=True)
        self.version += 1
        self.known.update({file: x["known"] for file, x in changes.items()})
        self._write("new", changes)
        if self.version % SNAPSHOT == 0:
            self._write("all", self.known)

    def _write(self, kind: str, what: dict) -> None:
        file = self._file(self.version, kind)
        with open(f"{file}.{uuid.uuid4().hex}", "w") as f:
            json.dump(what, f)
        os.replace(f.name, file)

    def forget(self, version: int) -> None:
        """Files of state that a stream at ``version`` needs no more."""
        full = version - version % SNAPSHOT
        if full and os.path.exists(self._file(full, "all")):
            for name in os.listdir(self.folder):
                if int(name.split(".")[0]) < full:
                    os.unlink(f"{self.folder}/{name}")


def look(known: dict[str, list[int]], files: Iterable[str], most_bytes: int | None = None) -> dict[str, dict]:
    """{file: {start, stop, known}} of the files that changed, as long as ``most_bytes`` aren't reached.

    A file that doesn't fit whole is read as far as it does, one line at least
    if it is the first.
    """
    out, left = {}, most_bytes
    for file in files:
        try:
            now = os.stat(file)
            was = known.get(file)
            if was and was[1:3] == [now.st_size, now.st_mtime_ns]:
                continue
            if left is not None and left <= 0:
                break
            at, size = (was[0] if was else 0), now.st_size
            if was and size < at:
                start = stop = line_end(file)
            else:
                start = at if not was or beginning(file, was[3]) == was[4] else 0
                stop = line_end(file, size)
                if left is not None and stop - start > left:
                    stop = line_end(file, start + left)
                    if stop <= start:
                        if out:
                            continue  # its turn comes when a batch begins with it
                        stop = next_line_end(file, start)
            whole = stop >= line_end(file, size)
            length = min(PRINT_BYTES, stop)
            out[file] = {"start": start, "stop": max(start, stop), "known": [max(start, stop), size if whole else -1, now.st_mtime_ns, length, beginning(file, length)]}
            left = None if left is None else left - (stop - start)
        except FileNotFoundError:
            continue
    return out


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str, size: int, skip_existing: bool, state: str, most_bytes: int | None) -> None:
        self.path, self.size, self.skip_existing, self.state, self.most_bytes = path, size, skip_existing, state, most_bytes
        self.at: Positions | None = None
        self.last = ""

    def _files(self) -> list[str]:
        """By name, from the one after the last that was read, so that none waits for good."""
        files = sorted(glob.iglob(self.path))
        k = bisect.bisect_right(files, self.last)
        return files[k:] + files[:k]

    def _now(self) -> Positions:
        """What was written last; a stream that goes on may be one version further than its checkpoint, and reads that next."""
        if self.at is None:
            self.at = Positions(self.state)
            self.at.load(self.at.newest())
        return self.at

    def initialOffset(self) -> dict:
        self._now()
        return self.latestOffset() if self.skip_existing else {"version": 0}

    def latestOffset(self) -> dict:
        at = self._now()
        changes = look(at.known, self._files(), self.most_bytes)
        if changes:
            at.save(changes)
            self.last = list(changes)[-1]
        return {"version": at.version}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        at, first = Positions(self.state), start["version"]
        if first:
            spans = [(file, x["start"], x["stop"]) for v in range(first + 1, end["version"] + 1) for file, x in at.changes(v).items()]
        else:  # from the start, whatever versions there were
            at.load(end["version"])
            spans = [(file, 0, x[0]) for file, x in sorted(at.known.items())]
        return [r for file, a, b in spans for r in ranges(file, a, b, self.size)]

    def commit(self, end: dict) -> None:
        Positions(self.state).forget(end["version"])

    def read(self, partition: Range) -> Iterator[tuple]:
        yield from read_range(partition)


class _Dealt(_Stream):
    """Several ranges a task."""

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        return dealt(super().partitions(start, end), self.size)

    def read(self, partition: Ranges) -> Iterator[tuple]:
        for part in partition.parts:
            yield from read_range(part)


class GrowingLogs(DataSource):
    """Options: path (a glob), rangeBytes; for streams also state (a folder), maxBytes (of a batch), skipExisting (start at the end of what is there)."""

    @classmethod
    def name(cls) -> str:
        return "growing_logs"

    def schema(self) -> str:
        return SCHEMA

    def _size(self) -> int:
        return int(self.options.get("rangeBytes", RANGE_BYTES))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options["path"], self._size())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        most = self.options.get("maxBytes")
        return _Dealt(self.options["path"], self._size(), self.options.get("skipExisting", "false") == "true", self.options["state"], int(most) if most else None)


def lines(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The lines of logs as they are now; large files are read in ranges.  line_no is the byte offset, in the lines' order."""
    spark.dataSource.register(GrowingLogs)
    return spark.read.format("growing_logs").option("path", path).option("rangeBytes", range_bytes).load()


def stream(spark: SparkSession, path: str, state: str, skip_existing: bool = False, range_bytes: int = RANGE_BYTES, max_bytes: int | None = None) -> DataFrame:
    """The lines of logs as they grow, each once.  A new checkpoint starts over.

    ``state``: a folder of this stream alone, which goes with its checkpoint.
    """
    spark.dataSource.register(GrowingLogs)
    reader = spark.readStream.format("growing_logs").option("path", path).option("rangeBytes", range_bytes).option("skipExisting", str(skip_existing).lower()).option("state", state)
    return (reader if max_bytes is None else reader.option("maxBytes", max_bytes)).load()
