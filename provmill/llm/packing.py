"""Best-fit packing of token sequences by minimum bin slack.

Documents become pieces of at most ``capacity`` tokens.  How the pieces share
bins depends only on how many pieces there are of each length, a table of at
most ``capacity`` rows.  On it bins are filled one kind at a time: the longest
length left is set, and a subset-sum search over the other lengths, held as
bits of one integer, finds the fullest feasible rest.  The combination is then
taken as often as the pieces last and removed.

The pieces themselves are never gathered: a piece's rank among those of its
length says which bin it goes to and where.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provmill.llm.common import remembered, text_column, texts, written

#: Units whose ids a worker remembers, and their longest length in characters: some 80 MB.
MOST_UNITS, LONGEST_UNIT = 400_000, 64
#: Marks that never share a token with a letter before them (fixed values; the apostrophe isn't one).
_MARKS = ".,;:!?*$%#&|)]}\""


class Words:
    """Ids of many lower-case words of Latin letters at once, by a library that takes ranks in place of merges.

    A word's end is a byte that no such word has, and token ids are in the order of merges.
    """

    def __init__(self, vocabulary: dict[str, int]) -> None:
        import tiktoken

        from provmill.llm.token_counts import byte_symbols

        back, ranks = {s: b for b, s in byte_symbols().items()}, {}
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            core = token.removesuffix("</w>")
            if all(c in back for c in core):
                self.ends[i] = core != token
                ranks.setdefault(bytes(back[c] for c in core) + b"\0" * (core != token), i)
        self.library = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})

    def encode(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.library.encode_ordinary("\0".join(words) + "\0"), "<u4")
        raw, cuts = ids.tobytes(), (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
        return [raw[i:j] for i, j in zip([0, *cuts], cuts, strict=False)]


class Encoder:
    """Token ids of whole texts, as unsigned 32-bit integers (little-endian, as the machines that Spark runs on).

    White space ends every token of a vocabulary that drops it, so a text's ids
    are those of its words; the library encodes each word once.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        normalizer = self.library.normalizer
        self.normal = normalizer.normalize_str if normalizer else str
        self.words = Words(self.library.get_vocab())
        self.ids: dict[str, bytes] = {"": b""}
        self.before: dict[str, bytes] = {}  # what was known when half of the bound was reached last

    def encode(self, text: str) -> bytes:
        # ASCII and Latin-1 letters have one lower-case form whatever stands beside them
        if "<|" not in text and (text.isascii() or not _beyond_latin(text)):
            text = text.lower()
        units = text.replace("\n", " ").split(" ")
        known = self.ids
        missing = {*units}.difference(known)
        if missing:
            if len(known) + 2 * len(missing) > MOST_UNITS // 2:
                self.before, known = known, {"": b""}
                self.ids, missing = known, {*units} - {""}
            again = self.before.keys() & missing
            for u in again:
                known[u] = self.before[u]
            missing -= again
            self.learn(missing)
            long = [u for u in missing if len(u) > LONGEST_UNIT]
            out = b"".join(map(known.__getitem__, units))
            for u in long:
                del known[u]
            return out
        return b"".join(map(known.__getitem__, units))

    def learn(self, units: set[str]) -> None:
        """A letter ends a token before a mark, so a word and the marks after it are looked up apart.

        What counts is the letter as the library normalises it: some become a
        letter and a combining mark, which shares a token with what follows.
        """
        known, apart, fresh = self.ids, [], set()
        for u in units:
            core = u.rstrip(_MARKS)
            if core and core != u and core[-1].isalpha() and (core[-1] <= "ÿ" or self.normal(core)[-1:].isalpha()):
                tail = u[len(core) :]
                apart.append((u, core, tail))
                if core not in known:
                    fresh.add(core)
                if tail not in known:
                    fresh.add(tail)
            else:
                fresh.add(u)
        plain = [u for u in fresh if u.isalpha() and u.islower() and u != "ª" and u != "º" and (u.isascii() or not _beyond_latin(u))]
        if plain:
            known.update(zip(plain, self.words.encode(plain), strict=True))
        fresh = list(fresh.difference(plain))
        for u, e in zip(fresh, self.library.encode_batch_fast(fresh, add_special_tokens=False), strict=True):
            known[u] = array("I", e.ids).tobytes()
        for u, core, tail in apart:
            known[u] = known[core] + known[tail]
        for u in (*plain, *fresh):
            if len(u) > LONGEST_UNIT and u not in units:
                del known[u]


def _beyond_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return True
    return False


def pieces(df: DataFrame, vocabulary: str, id: str = "doc_id", text: str = "text", end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of each piece of each row's ids and ``end_id``.

    A null or empty text is the end id alone.  Only texts of more than
    ``capacity`` ids are cut, into full pieces and a rest.
    """
    schema = T.StructType([df.schema[id]]).add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    end = np.array([end_id], "<u4").tobytes()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, encoder, width = to_arrow_schema(schema), remembered(("encoder", vocabulary), lambda: Encoder(vocabulary)), 4 * capacity
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(texts(batch, "__text")):
                ids = encoder.encode(t) + end
                for k in range(0, len(ids), width):
                    part = ids[k : k + width]
                    row.append(i)
                    piece.append(k // width)
                    start.append(k // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], schema=arrow)

    return df.select(id, text_column(df, text).alias("__text")).mapInArrow(cut_up, schema)


def fullest(target: int, lengths: list[int], left: dict[int, int]) -> list[tuple[int, int]]:
    """[(length, times)] with the largest sum of at most ``target``, by a bitset of reachable sums."""
    mask = (1 << (target + 1)) - 1
    reached, taken = 1, []
    for n in lengths:  # the longest first: short pieces fill gaps better later
        if n > target:
            continue
        copies, k = min(left[n], target // n), 1
        while copies > 0:  # 1, 2, 4, ... copies at once
            k = min(k, copies)
            taken.append((n, k, reached))
            reached |= (reached << n * k) & mask
            copies -= k
            k *= 2
        if reached >> target & 1:
            break
    total, used = reached.bit_length() - 1, {}
    for n, k, before in reversed(taken):
        if not before >> total & 1:
            total -= n * k
            used[n] = used.get(n, 0) + k
    return list(used.items())


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(bins, [(length, pieces of it in each)])] that hold all pieces counted."""
    left = {n: c for n, c in counts.items() if c}
    out = []
    lengths = sorted(left, reverse=True)
    while lengths:
        first = lengths[0]
        left[first] -= 1
        used = dict(fullest(capacity - first, [n for n in lengths if left[n]], left))
        left[first] += 1
        used[first] = used.get(first, 0) + 1
        times = min(left[n] // k for n, k in used.items())
        for n, k in used.items():
            left[n] -= times * k
        out.append((times, sorted(used.items(), reverse=True)))
        lengths = [n for n in lengths if left[n]]
    return out


def slots(bins: list[tuple[int, list[tuple[int, int]]]]) -> tuple[np.ndarray, ...]:
    """Sorted by (length, first rank): where the pieces of a length go, from that rank on.

    Columns: length, first rank, pieces a bin, first bin, offset in the bin.
    """
    rows, next_rank, next_bin = [], {}, 0
    for times, used in bins:
        offset = 0
        for n, k in used:
            rank = next_rank.get(n, 0)
            rows.append((n, rank, k, next_bin, offset))
            next_rank[n] = rank + times * k
            offset += n * k
        next_bin += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return tuple(table.T)


def pack(rows: DataFrame, capacity: int = 4096, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``rows`` with sequence_id and offset; each row takes up ``length`` of a sequence.

    Lengths are from 1 to ``capacity``.  Rows of one length that agree in
    ``order`` may change places.  An empty table gives an empty result.  The
    table is written out first, as it is read three times.
    """
    spark = rows.sparkSession
    rows = written(rows, "pieces")
    counts = {int(r[0]): int(r[1]) for r in rows.groupBy(length).count().collect()}  # capacity rows at most
    if any(n is None or not 1 <= n <= capacity for n in counts):
        raise ValueError(f"lengths have to be from 1 to {capacity}")
    shared = spark.sparkContext.broadcast(slots(plan(counts, capacity)))  # some rows for each length
    # ranks within a length: by hash bucket first, so that a length that most rows have is dealt out
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(counts.values()) // 50_000 + 1)
    dealt = rows.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = dealt.groupBy(length, "__b").agg(F.count("*").alias("__n"))
    before = before.withColumn("__before", F.sum("__n").over(Window.partitionBy(length).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))).select(F.col(length).alias("__l"), F.col("__b").alias("__c"), F.coalesce("__before", F.lit(0)).alias("__before"))
    ranked = dealt.withColumn("__k", F.row_number().over(Window.partitionBy(length, "__b").orderBy(*order)))
    ranked = ranked.join(before, (F.col(length) == F.col("__l")) & (F.col("__b") == F.col("__c"))).withColumn("__rank", F.col("__before") + F.col("__k") - 1)
    kept = rows.columns
    schema = T.StructType(rows.schema.fields).add("sequence_id", "long").add("offset", "long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        at_length, at_rank, per_bin, first_bin, first_offset = shared.value
        width = int(at_rank.max(initial=0)) + 2
        for batch in batches:
            n, rank = (batch.column(len(kept) + i).to_numpy(zero_copy_only=False) for i in range(2))
            # a length's ranks stay below those of the next length
            i = np.searchsorted(at_length * width + at_rank, n * width + np.minimum(rank, width - 1), side="right") - 1
            within = rank - at_rank[i]
            made = first_bin[i] + within // per_bin[i], first_offset[i] + within % per_bin[i] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(k).cast(arrow.field(k).type) for k in range(len(kept))), *(pa.array(x, pa.int64()) for x in made)], schema=arrow)

    return ranked.select(*kept, F.col(length).cast("long").alias("__length"), F.col("__rank").cast("long").alias("__r")).mapInArrow(place, schema)
