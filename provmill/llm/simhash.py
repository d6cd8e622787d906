"""Near-duplicate classes by SimHash and meet-in-the-middle ball hashing.

Two fingerprints differ in at most 2r bits exactly if some bit string differs
from each of them in at most r.  So every fingerprint emits its ball, all
strings within r bits of it; fingerprints that meet in a string are linked.

A ball of radius 2 over 64 bits has 2081 strings.  They aren't shipped one by
one: the strings are dealt to cells by their first bits, and a fingerprint is
sent, once, to each cell that its ball touches (those within r of its own first
bits); the cell makes just the strings that belong to it.  All fingerprints
that meet in a string are within 2r of each other, so linking each of them to
the least one of the string keeps every component; no pairs are listed.
"""

from __future__ import annotations

from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provmill.llm.common import arrow_map, cut, text_column, texts
from provmill.llm.components import components

#: Upper-case letters to lower case, the six ASCII blanks to a space (fixed values).
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz     ")

#: Strings that a task makes at a time, and at most keeps: memory, not results, depends on it.
CELL_STRINGS = 2_000_000
#: First bits that name a cell: at least and at most.
LEAST_BITS, MOST_BITS = 10, 20


def folded(text: str) -> list[bytes]:
    """The words of a text, A-Z in lower case."""
    return text.encode().translate(_FOLD).split()


def shingle_hashes(text: str, words: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of ``words`` words; of all of them if there are fewer."""
    parts = folded(text)
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = np.concatenate(([0], ends[:-1]))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[: 1 - words].tolist(), (ends[words - 1 :] - 1).tolist(), strict=True)), np.uint64, len(parts) - words + 1)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits set in over half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        block = hashes[i : i + 8192].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), words: int = 4, seed: int = 42) -> DataFrame:
    """``keep`` and fp, the 64-bit fingerprint as a signed long; null and wordless texts have 0."""
    schema = T.StructType([df.schema[k] for k in keep]).add("fp", "long")

    def make(batch: pa.RecordBatch) -> dict:
        fps = np.fromiter((majority(shingle_hashes(t, words, seed)) for t in texts(batch, "__text")), np.uint64, batch.num_rows)
        return {k: batch.column(i) for i, k in enumerate(keep)} | {"fp": fps.view(np.int64)}

    return arrow_map(df.select(*keep, text_column(df, text).alias("__text")), make, schema)


def ball(bits: range, radius: int) -> dict[int, np.ndarray]:
    """By number of bits: the masks with so many of ``bits`` set."""
    return {d: np.array([sum(1 << b for b in c) for c in combinations(bits, d)], np.uint64) for d in range(radius + 1)}


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index reachable from each of n nodes over the edges a-b."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def meetings(fps: np.ndarray, flips: np.ndarray, cell_bits: int, radius: int, part: int, parts: int, width: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (places in ``fps``) that chain the fingerprints of ``width`` bits whose balls meet in a string of a cell.

    ``flips``: in how many of the first bits each differs from the cell.  Of the
    cell's strings only those of one of ``parts`` hash classes are looked at.
    """
    rest = width - cell_bits
    inner = ball(range(rest), radius)
    low = np.uint64((1 << rest) - 1)
    strings, owners = [], []
    for d in range(radius + 1):
        of = np.flatnonzero(flips == d)
        masks = np.concatenate([inner[k] for k in range(radius - d + 1)])
        at_once = max(1, CELL_STRINGS // len(masks))
        for i in range(0, len(of), at_once):
            some = of[i : i + at_once]
            made = ((fps[some] & low)[:, None] ^ masks[None, :]).ravel()
            own = np.repeat(some.astype(np.int32), len(masks))
            if parts > 1:
                keep = ((made * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(parts) == np.uint64(part)
                made, own = made[keep], own[keep]
            strings.append(made)
            owners.append(own)
    s, o = np.concatenate(strings), np.concatenate(owners)
    order = np.argsort(s)
    s, o = s[order], o[order]
    del order
    same = s[1:] == s[:-1]
    # the few strings that several fingerprints share; their members in the order of ``fps``, which doesn't depend on how rows came
    shared = np.append(same, False) | np.append(False, same)
    s, o = s[shared], o[shared]
    order = np.lexsort((o, s))
    s, o = s[order], o[order]
    same = s[1:] == s[:-1]
    # a chain through the members of each string links just what a star would
    a, b = o[1:][same].astype(np.int64), o[:-1][same].astype(np.int64)
    pairs = np.unique(np.minimum(a, b) * len(fps) + np.maximum(a, b))
    a, b = pairs // len(fps), pairs % len(fps)
    near = np.bitwise_count(fps[a] ^ fps[b]) <= 2 * radius
    return a[near], b[near]


def meet(fps: np.ndarray, flips: np.ndarray, cell_bits: int, radius: int, part: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, least fingerprint of its local component) among the fingerprints whose balls touch a cell."""
    order = np.lexsort((flips, fps))
    fps, flips = fps[order], flips[order]
    a, b = meetings(fps, flips, cell_bits, radius, part, parts)
    root = _roots(len(fps), a, b)
    moved = np.flatnonzero(root != np.arange(len(fps)))
    return fps[moved], fps[root[moved]]


def links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """(u, v): enough links between distinct fingerprints to connect all that are ``distance`` or fewer bits apart, by any path.

    ``fps`` has a column fp of distinct fingerprints and is read three times.
    """
    if distance % 2:
        raise ValueError("distance has to be even: each side gets half of it")
    radius = distance // 2
    n = fps.count()
    per_ball = sum(len(x) for x in ball(range(64), radius).values())
    bits = LEAST_BITS
    while bits < MOST_BITS and n * per_ball > CELL_STRINGS << bits:
        bits += 1
    shift = 64 - bits
    found = fps.groupBy(F.shiftrightunsigned("fp", shift).alias("cell")).count().toPandas()  # 2**bits rows at most
    counts = np.zeros(1 << bits, np.int64)
    counts[found["cell"].to_numpy(np.int64)] = found["count"].to_numpy(np.int64)
    outer = ball(range(bits), radius)
    inside = np.cumsum([len(x) for x in ball(range(shift), radius).values()])
    made = np.zeros_like(counts)
    cells = np.arange(1 << bits, dtype=np.uint64)
    for d, masks in outer.items():
        for mask in masks:
            made += counts[(cells ^ mask).astype(np.int64)] * inside[radius - d]
    parts = np.maximum(1, -(-made // CELL_STRINGS)).astype(np.int32)
    shared = fps.sparkSession.sparkContext.broadcast(parts)
    flips = np.concatenate([np.full(len(m), d, np.int32) for d, m in outer.items()])
    masks = np.concatenate(list(outer.values()))

    def deal(batches):
        parts = shared.value
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(fp), 4096):
                some = fp[i : i + 4096]
                cell = ((some >> np.uint64(shift))[:, None] ^ masks[None, :]).ravel().astype(np.int64)
                own, flip = np.repeat(some, len(masks)), np.tile(flips, len(some))
                times = parts[cell]
                part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                cell, own, flip = (np.repeat(x, times) for x in (cell, own, flip))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(own.view(np.int64)), pa.array(flip)], names=["cell", "part", "fp", "flips"])

    def search(batches):
        """Rows come sorted by (cell, part)."""
        held: list[tuple] = []

        def rows():
            for batch in batches:
                cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
                key = cols[0].astype(np.int64) << 32 | cols[1]
                cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
                for x, y in zip(cuts, cuts[1:], strict=False):
                    if y > x:
                        yield int(key[x]), cols[2][x:y], cols[3][x:y]

        for key, run in groupby(rows(), key=lambda r: r[0]):
            held = list(run)
            fp = np.concatenate([r[1] for r in held]).view(np.uint64)
            flip = np.concatenate([r[2] for r in held])
            if len(fp) > 1:
                cell, part = key >> 32, key & 0xFFFFFFFF
                u, v = meet(fp, flip, bits, radius, part, int(shared.value[cell]))
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    dealt = fps.select("fp").mapInArrow(deal, "cell int, part int, fp long, flips int")
    return dealt.repartition("cell", "part").sortWithinPartitions("cell", "part").mapInArrow(search, "u long, v long").distinct()


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", words: int = 4, distance: int = 4, seed: int = 42) -> DataFrame:
    """id, fp (signed long), component (the least id reachable over links, itself included) of each row.

    Rows with equal fingerprints are linked, so repeated rows, empty and null
    texts share a component with their likes.  A null id stays null and takes
    part with no id of its own.  An empty table gives an empty result.
    """
    each = cut(fingerprints(df, text, (id,), words, seed))
    least = cut(each.groupBy("fp").agg(F.min(id).alias("least")))
    found = components(links(least, distance))
    member = cut(least.join(found, F.col("fp") == F.col("node")).select("fp", "root", "least"))
    lowest = member.groupBy("root").agg(F.min("least").alias("component"))
    grouped = member.join(lowest, "root").select("fp", "component")
    # with plain exchanges on both sides of the last join a large group can be split
    classes = cut(least.join(grouped, "fp", "left").select("fp", F.coalesce("component", "least").alias("component")))
    return each.join(classes, "fp").select(id, "fp", "component")


def representatives(df: DataFrame, id: str = "doc_id", text: str = "text", words: int = 4, distance: int = 4, seed: int = 42) -> DataFrame:
    """The rows of ``df`` that stay when one row of each class is kept: the one with the least id.

    Null ids come last; of rows with equal ids the one with the least
    fingerprint stays, then the one with the least digest of its text.  Of rows
    with the same id and text any one stays.
    """
    digest = F.unhex(F.md5(text_column(df, text).cast("binary")))  # id and text name a row's class; the id alone doesn't
    each = cut(fingerprints(df.withColumn("__digest", digest), text, (id, "__digest"), words, seed))
    first = F.min(F.struct(F.col(id).isNull().alias("none"), F.col(id).alias("id"), "fp", F.col("__digest").alias("digest")))
    heads = cut(each.groupBy("fp").agg(first.alias("head")))
    found = components(links(heads, distance))
    stays = heads.join(found, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("root", "fp").alias("class")).agg(F.min("head").alias("head"))
    keep = cut(stays.select(F.col("head.id").alias("__id"), F.col("head.digest").alias("__kept")))
    kept = df.withColumn("__digest", digest).join(keep, F.col(id).eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__kept"))).drop("__id", "__kept")
    repeated = each.groupBy(id, "__digest").count().where("count > 1").limit(1).count()
    return (kept.dropDuplicates([id, "__digest"]) if repeated else kept).drop("__digest")


def hex_fingerprint(column):
    """16 lower-case hexadecimal digits of a signed long."""
    return F.lpad(F.lower(F.hex(column)), 16, "0")
