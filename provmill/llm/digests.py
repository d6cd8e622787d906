"""Canonical exact digests of documents.

The canonical form folds compatibility forms (NFKC), case and white space.  The
digest is a 128-bit xxhash of it.  Equal digests are only candidates: inside a
bucket the canonical bytes are compared, and where they differ the digest is
extended by a SHA-256 part, so equal digests mean equal canonical bytes.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provmill.llm.common import arrow_map, text_column, texts, written

#: Stands for a null id where ids are ordered.
_NULL_ID = -(2**63)


def canonical(text: str) -> bytes:
    """Compatibility-normalised, case-folded, white space runs as one space, none at the ends."""
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode()


def digest(form: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(form)


#: Bits of the filter of repeated digests, a power of two: 8 MB, whatever the table's size.
FILTER_BITS = 26


def repeated(seen: DataFrame) -> bytes:
    """A filter of the digests (column fingerprint) that occur more than once.

    It has a bit for the first bits of each; a digest that shares its bit with
    another passes too, which costs a comparison and changes no result.
    """
    often = seen.groupBy("fingerprint").count().where("count > 1")
    slot = F.shiftright(F.conv(F.substring("fingerprint", 1, 7), 16, 10).cast("long"), 28 - FILTER_BITS)
    words = often.select(slot.alias("slot")).groupBy(F.expr("slot >> 6").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits"))
    found = words.toPandas()  # 2**20 rows at most
    out = np.zeros(1 << FILTER_BITS - 6, np.int64)
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return out.astype("<i8").tobytes()


def colliding(df: DataFrame, seen: DataFrame, text: str = "text", digest: Callable[[bytes], str] = digest) -> DataFrame:
    """(fingerprint) of every digest that stands for more than one canonical byte string.

    ``seen`` has the digests of all rows; canonical bytes travel only for those
    that occur more than once, and are compared in full.  Equal ones are first
    merged within each batch, so a text that fills a third of the table sends
    one row a batch.
    """
    shared, shift = df.sparkSession.sparkContext.broadcast(repeated(seen)), 28 - FILTER_BITS

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, bits = zstandard.ZstdCompressor(level=3).compress, shared.value
        for batch in batches:
            buckets: dict[str, list[bytes]] = {}
            for t in texts(batch, "__text"):
                form = canonical(t)
                fp = digest(form)
                slot = int(fp[:7], 16) >> shift
                if bits[slot >> 3] >> (slot & 7) & 1:
                    bucket = buckets.setdefault(fp, [])
                    if form not in bucket:
                        bucket.append(form)
            fps = [d for d, forms in buckets.items() for _ in forms]
            yield pa.RecordBatch.from_arrays([pa.array(fps, pa.string()), pa.array([pack(f) for forms in buckets.values() for f in forms], pa.binary())], names=["fingerprint", "form"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        last, first, told = None, None, None
        for batch in batches:
            found = []
            for fp, form in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if fp != last:
                    last, first = fp, form
                elif fp != told and form.as_py() != first.as_py() and unpack(form.as_py()) != unpack(first.as_py()):
                    found.append(fp)
                    told = fp
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["fingerprint"])

    forms = df.select(text_column(df, text).alias("__text")).mapInArrow(collapse, "fingerprint string, form binary")
    return forms.repartition("fingerprint").sortWithinPartitions("fingerprint").mapInArrow(compare, "fingerprint string")


def _wide(form: bytes) -> str:
    return hashlib.sha256(form).hexdigest()[:32]


def fingerprints(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), digest: Callable[[bytes], str] = digest) -> DataFrame:
    """``keep``, fingerprint, group_id and group_size of each row.

    Rows have equal fingerprints exactly if their canonical bytes are equal;
    group_id is the least of the first ``keep`` column among them, group_size
    their number.  Null texts are empty texts; all of them are one group.  Null
    ids stay, and are nobody's group_id unless all ids of the group are null.
    Repeated rows count as often as they occur; an empty table gives none.
    ``digest`` makes hexadecimal digits of canonical bytes.
    """
    schema = T.StructType([df.schema[k] for k in keep]).add("fingerprint", "string").add("__wide", "string")

    def make(batch: pa.RecordBatch) -> dict:
        forms = [canonical(t) for t in texts(batch, "__text")]
        return {k: batch.column(i) for i, k in enumerate(keep)} | {"fingerprint": list(map(digest, forms)), "__wide": list(map(_wide, forms))}

    each = written(arrow_map(df.select(*keep, text_column(df, text).alias("__text")), make, schema), "digests")
    each = written(resolve(each, colliding(df, each, text, digest), "fingerprint", "__wide"), "resolved")
    groups = written(each.groupBy("fingerprint").agg(F.min(keep[0]).alias("group_id"), F.count("*").alias("group_size")), "groups")
    return each.join(groups, "fingerprint").select(*keep, "fingerprint", "group_id", "group_size")


def resolve(df: DataFrame, collisions: DataFrame, fingerprint: str, wide: str) -> DataFrame:
    """Extend colliding fingerprints by their wide digest, which is dropped."""
    marked = df.join(collisions.select(F.col("fingerprint").alias("__hit")).distinct(), F.col(fingerprint) == F.col("__hit"), "left")
    extended = F.when(F.col("__hit").isNotNull(), F.concat_ws("-", fingerprint, wide)).otherwise(F.col(fingerprint))
    return marked.withColumn(fingerprint, extended).drop("__hit", wide)


def edited_texts(df: DataFrame, id: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """Digests of each text and of its edit, and how the text compares with its edit and its neighbour.

    The next document is that with the next lower id (after the lowest: the
    highest); of rows with equal ids the one with the lower hash of its text
    comes first, and null ids come last.  The edit replaces the last
    floor(n_chars / 3) code points by as many of the next text, or all it has.
    Returns id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    next_fingerprint and a wide digest for each of the three.

    Rows are dealt to ranges of ids that are laid down from the ids' quantiles;
    a range also gets the first rows of the range that follows.  Digests of the
    texts themselves are made before that.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col(id).cast("long"), F.lit(_NULL_ID))
    ids = df.select(key.alias("k"))
    marks = ids.agg(F.percentile_approx("k", [i / n for i in range(1, n)], 100 * n)).first()[0] if n > 1 else []
    splits = np.unique(np.array(marks or [], np.int64))

    def range_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, int] = {}
        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(k)
            k, p = k[order], np.searchsorted(splits, k[order], side="left")
            for i in np.flatnonzero(np.append(p[1:] != p[:-1], True))[: len(p)].tolist():
                best[int(p[i])] = max(best.get(int(p[i]), int(k[i])), int(k[i]))
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), pa.array(list(best.values()), pa.int64())], names=["p", "head"])

    heads = {r["p"]: r["head"] for r in ids.mapInArrow(range_heads, "p int, head long").groupBy("p").agg(F.max("head").alias("head")).collect()}  # one row a range
    order = sorted(heads)
    above = {p: order[(i + 1) % len(order)] for i, p in enumerate(order)}

    kind = df.schema[id]
    sent = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("guest", T.BooleanType()), T.StructField("k", T.LongType()), T.StructField("tie", T.LongType()), T.StructField("id", kind.dataType), T.StructField("body", T.BinaryType()), T.StructField("fp", T.StringType()), T.StructField("wide", T.StringType())])

    def send(batch: pa.RecordBatch) -> dict:
        pack = zstandard.ZstdCompressor(level=3).compress
        k = batch.column(1).to_numpy(zero_copy_only=False)
        part = np.searchsorted(splits, k, side="left")
        raw, forms = zip(*((t.encode(), canonical(t)) for t in texts(batch, "__text")), strict=True)
        fp, wide = pa.array(map(digest, forms), pa.string()), pa.array(map(_wide, forms), pa.string())
        tie = np.fromiter((xxhash.xxh3_64_intdigest(r) for r in raw), np.uint64, len(raw)).view(np.int64)
        body = list(map(pack, raw))
        guests = [i for i, (p, x) in enumerate(zip(part.tolist(), k.tolist(), strict=True)) if heads[p] == x]
        rows = np.concatenate([np.arange(len(raw)), np.array(guests, np.int64)])
        to = np.concatenate([part, np.array([above[int(part[i])] for i in guests], np.int64)])
        return {"part": to, "guest": np.arange(len(rows)) >= len(raw), "k": k[rows], "tie": tie[rows], "id": batch.column(0).take(pa.array(rows)), "body": [body[i] for i in rows.tolist()], "fp": fp.take(pa.array(rows)), "wide": wide.take(pa.array(rows))}

    out = T.StructType([kind, *(T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint", "wide", "edited_wide", "next_wide"))])
    out = T.StructType([out.fields[0], T.StructField("n_chars", T.LongType()), *out.fields[1:]])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, unpack = to_arrow_schema(out), zstandard.ZstdDecompressor().decompress
        held, held_part, done = None, None, []

        def finish(row, following) -> None:
            key, text, fp, wide = row
            cut_at = len(text) - len(text) // 3
            edited = text[:cut_at] + following[1][: len(text) // 3]
            edit = canonical(edited)
            done.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), fp, digest(edit), following[2], wide, _wide(edit), following[3]))

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*done, strict=True), arrow, strict=True)], schema=arrow)
            done.clear()
            return made

        for batch in batches:
            parts, guests = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, (part, guest) in enumerate(zip(parts, guests, strict=True)):
                if guest and (held is None or part != held_part):
                    continue  # a further guest of a range that is done
                row = batch.column(4)[i].as_py(), unpack(batch.column(5)[i].as_py()).decode(), batch.column(6)[i].as_py(), batch.column(7)[i].as_py()
                if held is not None and part == held_part:
                    finish(held, row)
                held, held_part = (None if guest else row), part
                if len(done) >= 4096:
                    yield flush()
        if done:
            yield flush()

    dealt = arrow_map(df.select(F.col(id), key.alias("k"), text_column(df, text).alias("__text")), send, sent)
    sort = ["part", "guest", F.desc("k"), "tie"]
    return dealt.repartitionById(n, F.col("part")).sortWithinPartitions(*sort).mapInArrow(compare, out)
