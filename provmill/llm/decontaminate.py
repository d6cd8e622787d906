"""Benchmark decontamination by Wu-Manber multi-pattern search.

A text becomes its words with one space around each, so that a window of words
is a byte string and occurs as words exactly if it occurs as bytes.  The search
looks at the last block of a position as long as the shortest pattern: a shift
table says how far the next possible position is; where it says none, the hash
of the position's suffix selects a bucket of patterns and comparison decides.

Patterns are searched in classes of like length, so that a short one doesn't
shorten the shifts of the rest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provmill.llm.common import arrow_map, remembered, text_column, texts

#: Word bytes: 0-9, a-z (from A-Z too) and all of 0x80 and above; the rest separates (fixed values).
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Windows searched for in one pass over the documents; more are searched in further passes.
WINDOWS_A_PASS = 30_000
#: Bytes of the suffix that selects a bucket; what stands before them in a window tells few more apart.
SUFFIX = 24
#: Least lengths of the classes of patterns.
CLASSES = (48, 32, 16, 8, 0)

_numbers = count()


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


def windows_of(text: str, size: int) -> set[bytes]:
    """The item's windows, framed by spaces: ``size`` consecutive words, or all if there are fewer."""
    w = words_of(text)
    return {b" %b " % b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


class WuManber:
    """Finds all occurrences of patterns that have one least length."""

    def __init__(self, patterns: list[bytes]) -> None:
        self.least = m = min(map(len, patterns))
        self.block = b = max(1, min(8, m // 3))
        self.far = m - b + 1
        self.suffix = min(m, SUFFIX)
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[int, list[bytes]] = {}
        for p in patterns:
            for end in range(b, m + 1):
                key = p[end - b : end]
                self.shift[key] = min(self.shift.get(key, self.far), m - end)
            self.bucket.setdefault(xxhash.xxh3_64_intdigest(p[m - self.suffix : m]), []).append(p)

    def find(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        """(start, pattern) of each occurrence."""
        m, b, far, shift, bucket, suffix, digest = self.least, self.block, self.far, self.shift.get, self.bucket.get, self.suffix, xxhash.xxh3_64_intdigest
        end, n = m, len(text)
        while end <= n:
            jump = shift(text[end - b : end], far)
            if jump:
                end += jump
                continue
            for p in bucket(digest(text[end - suffix : end]), ()):
                if text.startswith(p, end - m):
                    yield end - m, p
            end += 1


class Matcher:
    """Windows of items, compiled."""

    def __init__(self, windows: list[tuple[bytes, list[str]]]) -> None:
        self.items = dict(windows)
        self.size = {p: p.count(b" ") - 1 for p in self.items}
        left, self.parts = list(self.items), []
        for least in CLASSES:
            some = [p for p in left if len(p) >= least]
            left = [p for p in left if len(p) < least]
            if some:
                self.parts.append(WuManber(some))

    def search(self, text: str) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words; word ranges hit; items that occur."""
        w = words_of(text)
        joined = b" %b " % b" ".join(w)
        found = [(at, p) for part in self.parts for at, p in part.find(joined)] if w else []
        spans, items = [], set()
        if found:
            found.sort()
            at_word = last = 0
            for at, p in found:
                at_word += joined.count(b" ", last, at)
                last = at
                spans.append((at_word, at_word + self.size[p]))
                items.update(self.items[p])
        return len(w), spans, items


def covered(spans: list[tuple[int, int]]) -> int:
    """Words in any of the ranges."""
    total = end = 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


class _Shared:
    """A broadcast with a number that tells passes apart in a worker that serves several."""

    def __init__(self, spark, windows) -> None:
        self.id, self._value = f"{spark.sparkContext.applicationId}-{next(_numbers)}", spark.sparkContext.broadcast(windows)

    @property
    def value(self):
        return self._value.value


def _passes(benchmark: DataFrame, item: str, text: str, size: int, least_words: int, at_most: int) -> Iterator[list[tuple[bytes, list[str]]]]:
    """The benchmark's windows with their items, in blocks of bounded number; items come one by one."""
    block: dict[bytes, set[str]] = {}
    rows = benchmark.where(F.col(item).isNotNull()).select(F.col(item).cast("string"), text_column(benchmark, text))
    for name, value in rows.toLocalIterator():
        if len(words_of(value)) < least_words:
            continue
        for w in windows_of(value, size):
            block.setdefault(w, set()).add(name)
        if len(block) >= at_most:
            yield [(w, sorted(n)) for w, n in block.items()]
            block = {}
    yield [(w, sorted(n)) for w, n in block.items()]


def contamination(
    df: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item: str = "item_id", item_text: str = "text", size: int = 10, least_words: int = 1, windows_a_pass: int = WINDOWS_A_PASS
) -> DataFrame:
    """``keep``, n_words, n_hit, n_items, items_sha256, contaminated and spans (hit word ranges) of each row.

    A word is hit if it is inside an occurrence of a window of an item; items of
    fewer than ``least_words`` words are left out.  Null texts have no words, so
    they have no hits; items with null ids or no words have no windows.  Equal
    items, repeated rows and items that share windows each count.  With an empty
    benchmark nothing is hit; an empty table gives an empty result.
    """
    spark = df.sparkSession
    span = T.ArrayType(T.StructType().add("start", "integer").add("end", "integer"))
    work = df.select(*keep, text_column(df, text).alias("__text"), F.lit(None).cast(span).alias("__spans"), F.lit(None).cast("array<string>").alias("__items"))
    kept = [df.schema[k] for k in keep]
    between = T.StructType([*kept, T.StructField("__text", T.StringType()), T.StructField("__spans", span), T.StructField("__items", T.ArrayType(T.StringType()))])
    final = T.StructType(kept).add("n_words", "long").add("n_hit", "long").add("n_items", "long").add("items_sha256", "string").add("contaminated", "boolean").add("spans", span)

    def search(shared, last: bool):
        def make(batch: pa.RecordBatch) -> dict:
            matcher, n = remembered(shared.id, lambda: Matcher(shared.value)), len(keep)
            sizes, spans, items = [], [], []
            before = zip(batch.column(n + 1).to_pylist(), batch.column(n + 2).to_pylist(), strict=True)
            for t, (had_spans, had_items) in zip(texts(batch, "__text"), before, strict=True):
                words, hit, named = matcher.search(t)
                sizes.append(words)
                spans.append([(s["start"], s["end"]) for s in had_spans or ()] + hit)
                items.append(sorted(named.union(had_items or ())))
            out = {k: batch.column(i) for i, k in enumerate(keep)}
            as_rows = [[{"start": a, "end": b} for a, b in s] for s in spans]
            if not last:
                return out | {"__text": batch.column(n), "__spans": as_rows, "__items": items}
            n_hit = [covered(s) for s in spans]
            digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            return out | {"n_words": sizes, "n_hit": n_hit, "n_items": list(map(len, items)), "items_sha256": digest, "contaminated": [h > 0 for h in n_hit], "spans": as_rows}

        return make

    blocks = _passes(benchmark, item, item_text, size, least_words, windows_a_pass)
    now = next(blocks)
    for after in blocks:
        work = arrow_map(work, search(_Shared(spark, now), False), between)
        now = after
    return arrow_map(work, search(_Shared(spark, now), True), final)
