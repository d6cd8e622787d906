"""Packing without padding by non-negative least squares on the histogram of lengths.

A document of more than ``capacity`` tokens gives full windows and a rest.  Of
the lengths that occur, combinations of one or two, each taken some times, that
fill a window exactly are enumerated.  How often each is used solves a
non-negative least-squares problem against the histogram; the solution is
rounded, taken as far as the pieces last, and solved again on what is left
until nothing more comes of it.

What still is left goes greedily, the longest first, into windows that are
filled to the brim: a piece that doesn't fit is cut there.  So the place of a
piece follows from its length and its rank among those of its length, however
many there are.  The very last window would be padded; its content is cut into
powers of two instead, which need no padding.

The histogram has at most ``capacity`` rows and is all that the driver sees.
Ids are stored once, beside each piece's rank in its task; only pieces that are
cut are joined to them again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provmill.llm.common import remembered, text_column, texts, written
from provmill.llm.packing import Encoder

#: Sweeps of the solver over all combinations and the least relative gain of one.
SWEEPS, LEAST_GAIN = 25, 1e-3


def combinations(counts: np.ndarray) -> np.ndarray:
    """Rows (length, times, other length, times), the first the longer, that fill a window; the other's times may be 0.

    ``counts`` has the pieces of each length from 0 to the capacity.
    """
    capacity = len(counts) - 1
    lengths = np.flatnonzero(counts)
    multiples = np.concatenate([np.stack([lengths, np.full(len(lengths), k)], 1)[(lengths * k <= capacity) & (counts[lengths] >= k)] for k in range(1, capacity + 1)])
    total = multiples.prod(1)
    multiples, total = multiples[order := np.argsort(total, kind="stable")], total[order]
    lo, hi = np.searchsorted(total, capacity - total, "left"), np.searchsorted(total, capacity - total, "right")
    first = np.repeat(np.arange(len(total)), hi - lo)
    second = np.arange(len(first)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
    both = np.concatenate([multiples[first], multiples[second]], 1)
    alone = multiples[total == capacity]
    return np.concatenate([np.concatenate([alone, np.zeros_like(alone)], 1), both[both[:, 0] > both[:, 2]]])


def least_squares(columns: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How often each combination is used, not below 0, so that the lengths used come closest to ``counts``.

    By coordinate descent: each step is the best for one combination, and the
    combinations that gain most come first.
    """
    rest = counts.astype(float)
    a, m, b, n = columns.T
    square, uses = (m * m + n * n).astype(float), np.zeros(len(columns))
    error = float(rest @ rest)
    for _ in range(SWEEPS):
        slope = m * rest[a] + n * rest[b]
        moving = np.flatnonzero((slope > 0.01 * square) | (uses > 0) & (slope < -0.01 * square))
        moving = moving[np.argsort(-slope[moving] / square[moving], kind="stable")]
        left, own = rest.tolist(), uses.tolist()
        for c, la, ma, lb, nb, s in zip(moving.tolist(), a[moving].tolist(), m[moving].tolist(), b[moving].tolist(), n[moving].tolist(), square[moving].tolist(), strict=True):
            step = max((ma * left[la] + nb * left[lb]) / s, -own[c])
            own[c] += step
            left[la] -= ma * step
            left[lb] -= nb * step
        rest, uses, before = np.array(left), np.array(own), error
        error = float(rest @ rest)
        if before - error <= LEAST_GAIN * before:
            break
    return uses


def plan(counts: np.ndarray) -> tuple[list[tuple[int, list[tuple[int, int]]]], np.ndarray]:
    """[(windows, [(length, pieces of it in each)])] that are full, and the pieces of each length that are left."""
    left, out = counts.astype(np.int64), []
    left[0] = 0
    while left.any():
        columns = combinations(left)
        uses = least_squares(columns, left)
        used = 0
        for c in np.argsort(-uses, kind="stable")[: int((uses > 0).sum())]:
            a, m, b, n = columns[c].tolist()
            times = min(max(1, round(uses[c])), left[a] // m, left[b] // n if n else left[a] // m)
            if times > 0:
                left[a] -= times * m
                left[b] -= times * n
                out.append((int(times), [(a, m)] + [(b, n)] * (n > 0)))
                used += times
        if not used:
            break
    return out, left


class Places:
    """Where the pieces of each length go, by rank: full windows first, then what is left, end to end."""

    def __init__(self, counts: np.ndarray) -> None:
        bins, left = plan(counts)
        self.capacity = len(counts) - 1
        rows, rank, window = [], np.zeros(len(counts), np.int64), 0
        for times, used in bins:
            offset = 0
            for n, k in used:
                rows.append((n, rank[n], k, window, offset))
                rank[n] += times * k
                offset += n * k
            window += times
        position = 0
        for n in np.flatnonzero(left)[::-1]:
            rows.append((n, rank[n], 0, position, 0))  # 0 pieces a window: on the tape
            position += n * left[n]
        table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.length, self.rank, self.per, self.first, self.offset = table.T
        #: Windows before the tape, and the ends of the tape's sequences: full ones by arithmetic, then powers of two.
        self.before, self.full = window, position // self.capacity
        rest, ends = position % self.capacity, [self.full * self.capacity]
        for bit in reversed(range(self.capacity.bit_length())):
            if rest >> bit & 1:
                ends.append(ends[-1] + (1 << bit))
        self.ends = np.array(ends, np.int64)
        self.wide = int(counts.max(initial=0)) + 1

    def place(self, length: np.ndarray, rank: np.ndarray) -> list[list[tuple[int, int, int, int]]]:
        """Of each piece [(start in it, length, sequence, offset)]."""
        i = np.searchsorted(self.length * self.wide + self.rank, length * self.wide + rank, side="right") - 1
        within, per, out = rank - self.rank[i], self.per[i], []
        window = self.first[i] + within // np.maximum(per, 1)
        offset = self.offset[i] + within % np.maximum(per, 1) * length
        position = self.first[i] + within * length
        for n, p, w, o, at in zip(length.tolist(), per.tolist(), window.tolist(), offset.tolist(), position.tolist(), strict=True):
            out.append([(0, n, w, o)] if p else self.along(at, n))
        return out

    def along(self, at: int, length: int) -> list[tuple[int, int, int, int]]:
        out, done, tail = [], 0, int(self.ends[0])
        while done < length:
            here = at + done
            if here < tail:
                k, start = divmod(here, self.capacity)[0], here // self.capacity * self.capacity
                end = start + self.capacity
            else:
                j = int(np.searchsorted(self.ends, here, side="right"))
                k, start, end = self.full + j - 1, int(self.ends[j - 1]), int(self.ends[j])
            n = min(length - done, end - here)
            out.append((done, n, self.before + k, here - start))
            done += n
        return out


def _pieces(df: DataFrame, vocabulary: str, id: str, text: str, end_id: int, capacity: int) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, part, rank, ids) of each piece; rank counts those of its length in the task ``part``."""
    schema = T.StructType([df.schema[id]])
    for c in ("start", "length", "ids_crc32", "doc_tokens", "part", "rank"):
        schema.add(c, "long")
    schema = schema.add("ids", "binary")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, encoder, width = to_arrow_schema(schema), remembered(("encoder", vocabulary), lambda: Encoder(vocabulary)), 4 * capacity
        part, ranks = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            rows, held = [], 0
            for i, t in enumerate(texts(batch, "__text")):
                ids = encoder.encode(t) + end
                for k in range(0, len(ids), width):
                    own = ids[k : k + width]
                    n = len(own) // 4
                    short = None if n == capacity else _narrow(own)  # a full window is never cut
                    rows.append((i, k // 4, n, zlib.crc32(own), len(ids) // 4, part, ranks[n], short))
                    ranks[n] += 1
                    held += len(short or b"") + 100
                if held > 16_000_000:
                    yield _batch(batch, rows, arrow)
                    rows, held = [], 0
            if rows:
                yield _batch(batch, rows, arrow)

    return df.select(id, text_column(df, text).alias("__text")).mapInArrow(run, schema)


def _batch(source: pa.RecordBatch, rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    """Rows whose first value is the place of the id in ``source``."""
    at, *rest = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([source.column(0).take(pa.array(at)), *(pa.array(x, f.type) for x, f in zip(rest, list(arrow)[1:], strict=True))], schema=arrow)


def _narrow(ids: bytes) -> bytes:
    """Two bytes an id and a mark where all are that small, else four."""
    wide = np.frombuffer(ids, "<u4")
    return wide.astype("<u2").tobytes() + b"2" if wide.max() < 1 << 16 else ids + b"4"


def _wide(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids[:-1], f"<u{ids[-1:].decode()}").astype("<u4")


def pack(df: DataFrame, vocabulary: str, id: str = "doc_id", text: str = "text", end_id: int = 2, capacity: int = 4096) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of each piece; each token is in exactly one.

    ``start`` counts the row's tokens before the piece, ``doc_tokens`` all of
    them with ``end_id``, which follows each row's ids; a null or empty text is
    that id alone.  Every sequence has ``capacity`` tokens or a power of two.
    Repeated rows and ids are packed each.  Rows of one length may change
    places.  An empty table gives an empty result.  Other columns are left out.
    """
    spark = df.sparkSession
    pieces = written(_pieces(df, vocabulary, id, text, end_id, capacity), "pieces")
    parts = written(pieces.groupBy("length", "part").agg(F.count("*").alias("many")), "ranks")
    counts = np.zeros(capacity + 1, np.int64)
    for n, many in parts.groupBy("length").agg(F.sum("many")).collect():  # capacity rows at most
        counts[n] = many
    shared = spark.sparkContext.broadcast(Places(counts))  # some rows for each length
    before = F.coalesce(F.sum("many").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = pieces.drop("ids").join(parts.select("length", "part", before.alias("before")), ["length", "part"])
    ranked = ranked.select(id, "start", "length", "ids_crc32", "doc_tokens", "part", "rank", (F.col("before") + F.col("rank")).alias("__rank"))
    schema = T.StructType([f for f in ranked.schema.fields if f.name != "__rank"]).add("places", T.ArrayType(T.ArrayType(T.LongType())))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            if batch.num_rows:
                length, rank = batch.column(2).to_numpy(), batch.column(7).to_numpy()
                yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(shared.value.place(length, rank), arrow.field(7).type)], schema=arrow)

    placed = written(ranked.mapInArrow(place, schema), "placed")
    final = T.StructType([df.schema[id]])
    for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"):
        final.add(c, "long")
    only = F.col("places")[0]
    whole = placed.where(F.size("places") == 1).select(id, "start", "length", "ids_crc32", "doc_tokens", only[2].alias("sequence_id"), only[3].alias("offset"))
    # a table of its own, whose size is known: as long as it is small, Spark leaves the ids where they are
    parted = written(placed.where(F.size("places") > 1).select(id, "start", "doc_tokens", "places", "length", "part", "rank"), "cut")
    several = parted.join(pieces.where("ids is not null").select("length", "part", "rank", "ids"), ["length", "part", "rank"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(final)
        for batch in batches:
            rows = []
            for i, (start, total, places, ids) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True)):
                tokens = _wide(ids)
                rows += [(i, start + s, n, zlib.crc32(tokens[s : s + n].tobytes()), total, w, o) for s, n, w, o in places]
            if rows:
                yield _batch(batch, rows, arrow)

    return whole.unionAll(several.select(id, "start", "doc_tokens", "places", "ids").mapInArrow(cut, final))
