"""WARC archives: writing with revisits, reading by boundary chains.

An archive is read in splits, each by its own task, so a task can't know where
records begin: a payload may hold the magic line too.  Every occurrence of the
magic is a candidate with a successor, where its declared length ends.  Tasks
emit candidates and successors; pointer jumping from the start of each file
keeps just those that the chain of successors reaches.

Within a split the chain is followed at once, so pointers only jump from split
to split, doubling their reach each round.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import groupby
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provmill.llm.common import arrow_map, cut, shared_path, text_column, texts, written

MAGIC = "WARC/1.1\r\n"
#: What ends a record after its block (fixed value).
TAIL = "\r\n\r\n"
_HEADER = re.compile(rb"([!-9;-~]+):[ \t]*([^\r\n]*)\r\n")
#: Up to so many rows are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 100_000


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(value) -> str:
    return f"<urn:page:{'' if value is None else quote(str(value), safe='')}>"


def record(id_, url: str | None, payload: str, sha1: str, kind: str, refers_to, date: str) -> str:
    """A response or revisit record without the last line end; the payload is the body of an HTTP response."""
    size = len(payload.encode())
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    head = {"WARC-Type": kind, "WARC-Record-ID": _urn(id_), "WARC-Date": date, "WARC-Target-URI": re.sub(r"[\r\n]+", "", url or ""), "WARC-Payload-Digest": f"sha1:{sha1}", "Content-Type": "application/http; msgtype=response"}
    if kind == "revisit":
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": _urn(refers_to)}
    else:
        block += payload
    head["Content-Length"] = str(len(block.encode()))
    return MAGIC + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n" + block + "\r\n"


def write_archives(df: DataFrame, path: str, id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record for each row, as WARC files in the folder ``path``.

    Of rows with equal payloads of at least ``least_bytes`` bytes the one with
    the least id is the response and the others revisit it; rows that share that
    id and payload all are responses.  A null payload is empty; a null id is
    never referred to unless all ids of the payload are null.
    """
    schema = T.StructType([T.StructField("id", df.schema[id].dataType), T.StructField("url", T.StringType()), T.StructField("payload", T.StringType()), T.StructField("sha1", T.StringType()), T.StructField("size", T.LongType())])

    def identify(batch: pa.RecordBatch) -> dict:
        raw = [t.encode() for t in texts(batch, "__payload")]
        return {"id": batch.column(0), "url": batch.column(1), "payload": batch.column(2), "sha1": list(map(digest, raw)), "size": list(map(len, raw))}

    rows = arrow_map(df.select(F.col(id), F.col(url).cast("string").alias("url"), text_column(df, payload).alias("__payload")), identify, schema)
    keys = written(rows.select("id", "sha1", "size").distinct(), "digests")
    first = written(keys.where(F.col("size") >= least_bytes).groupBy("sha1").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "groups")
    kinds = written(keys.join(first, "sha1").where(~F.col("id").eqNullSafe(F.col("first"))).select("id", "sha1", "first"), "revisits")
    again = kinds.select(F.col("id").alias("i"), F.col("sha1").alias("s"), "first", F.lit(True).alias("again"))
    same = (F.col("sha1") == F.col("s")) & F.col("id").eqNullSafe(F.col("i"))
    if kinds.count() <= BROADCAST_ROWS:
        again = F.broadcast(again)
    full = rows.join(again, same, "left")

    def render(batch: pa.RecordBatch) -> dict:
        return {"value": [record(i, u, p, d, "revisit" if r else "response", f, date) for i, u, p, d, f, r in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True)]}

    lines = arrow_map(full.select("id", "url", "payload", "sha1", "first", "again"), render, T.StructType().add("value", "string"))
    lines.write.option("lineSep", "\r\n").text(path)


def _declared(line: bytes) -> tuple[int, dict[str, str]] | None:
    """(where the block begins, headers) of a candidate, or None if it isn't a header."""
    end = line.find(b"\r\n\r\n")
    if end < 0:
        return None
    at, headers = 0, {}
    while at < end + 2:
        m = _HEADER.match(line, at)
        if not m:
            return None
        headers[m[1].decode().lower()] = m[2].decode("utf-8", "replace").strip()
        at = m.end()
    return (end + 4, headers) if headers.get("content-length", "").isdigit() else None


def _payload(block: bytes, headers: dict[str, str]) -> tuple[int, str | None]:
    """Bytes and digest of the HTTP body; a revisit declares them."""
    head, _, body = block.partition(b"\r\n\r\n") if headers.get("content-type", "").startswith("application/http") else (b"", b"", block)
    if headers.get("warc-type") == "revisit":
        m = re.search(rb"(?im)^content-length:[ \t]*(\d+)", head)
        return int(m[1]) if m else 0, headers.get("warc-payload-digest", "").rpartition(":")[2] or None
    return len(body), digest(body)


_ROW = "file string, split long, k int, rel long, size long, succ long, exit long, whole boolean, type string, id string, url string, date string, refers_to string, payload_bytes long, payload_digest string"


def _read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, body): what stands between magics, in order within a split; a file's first is what stands before the first."""
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("body"))


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[bytes]]]:
    """(file, split, its bodies) one after the other."""
    rows = ((f, s, body) for batch in batches for f, s, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True))
    for (f, s), run in groupby(rows, key=lambda r: r[:2]):
        yield f, s, (r[2].as_py() for r in run)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each body: its place in the split, and what it declares if it is a candidate."""
    step = len(MAGIC)
    names = [c.split()[0] for c in _ROW.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    types = [kinds[c.split()[1]] for c in _ROW.split(", ")]
    for file, split, bodies in _splits(batches):
        rows, at = [], 0
        for k, body in enumerate(bodies):
            head = _declared(body) if k or split else None
            row = [file, split, k, at - step, len(body) + step, None, None, False, *[None] * 7]
            if head:
                begin, h = head
                stop = begin + int(h["content-length"])
                row[5] = at + stop + len(TAIL)
                row[7] = stop + len(TAIL) == len(body) and body.endswith(TAIL.encode())
                n, sha1 = _payload(body[begin:stop], h) if row[7] else (None, None)
                row[8:] = [h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-refers-to"), n, sha1]
            rows.append(row)
            at += len(body) + step
        place = {row[3]: i for i, row in enumerate(rows) if row[5] is not None}
        for row in reversed(rows):  # where the chain leaves the split
            if row[5] is not None:
                i = place.get(row[5])
                row[6] = rows[i][6] if i is not None else row[5]
        for i in range(0, len(rows), 10_000):
            part = rows[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names=names)


def reachable(candidates: DataFrame, most_rounds: int = 40) -> DataFrame:
    """The candidates that the chain from each file's first reaches.

    ``candidates``: file, split, start, succ and exit (places in the file).  The
    result has file, split and start.
    """
    own = candidates.where("succ is not null")
    entries = own.groupBy("file").agg(F.min("start").alias("start")).where("start = 0")
    exits = own.select("file", F.col("exit").alias("start")).distinct()
    jump = cut(own.join(exits.unionAll(entries).distinct(), ["file", "start"]).select("file", "start", F.col("exit").alias("to")))
    seen = cut(jump.join(entries, ["file", "start"]).select("file", "start"))
    n = seen.count()
    for _ in range(most_rounds):
        further = jump.join(seen, ["file", "start"]).select("file", F.col("to").alias("start"))
        now = cut(seen.unionAll(further).distinct())
        grown = now.count()
        seen = now
        if grown == n:
            break
        n = grown
        onward = jump.select("file", F.col("start").alias("to"), F.col("to").alias("after"))
        jump = cut(jump.join(onward, ["file", "to"], "left").select("file", "start", F.coalesce("after", "to").alias("to")))
    else:
        raise RuntimeError(f"chains not followed to their ends after {most_rounds} rounds")
    marked = own.join(seen.withColumn("entry", F.lit(True)), ["file", "start"], "left").select("file", "split", "start", "succ", F.coalesce("entry", F.lit(False)).alias("entry"))

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        """A split's candidates: those on the chain of an entry."""
        succ = dict(zip(pdf["start"].tolist(), pdf["succ"].tolist(), strict=True))
        on: set[int] = set()
        for at in pdf.loc[pdf["entry"], "start"].tolist():
            while at in succ and at not in on:
                on.add(at)
                at = succ[at]
        return pdf.loc[pdf["start"].isin(on), ["file", "split", "start"]]

    return marked.groupBy("file", "split").applyInPandas(follow, "file string, split long, start long")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all WARC files in ``path``: file, start, type, id, url, date, refers_to, payload_bytes, payload_digest.

    Digests of responses are made from the payloads that were read; those of
    revisits are the declared ones.  What the chain of successors from a file's
    start doesn't reach isn't a record, and neither is a last record that ends
    after the file.  A folder without records gives an empty result.
    """
    found = written(_read_lines(spark, path).mapInArrow(_candidates, _ROW), "candidates")
    sizes = found.groupBy("file", "split").agg(F.sum("size").alias("bytes"), F.min("rel").alias("first"))
    places = sizes.withColumn("base", F.coalesce(F.sum("bytes").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # a file's first body stands before any magic, which its rel counts
    file_end = places.groupBy("file").agg((F.sum("bytes") - len(MAGIC)).alias("end"))
    placed = found.join(places.select("file", "split", "base"), ["file", "split"]).join(file_end, "file")
    placed = cut(placed.select("*", *((F.col("base") + F.col(a)).alias(b) for a, b in (("rel", "start"), ("succ", "to"), ("exit", "out")))).drop("base", "succ", "exit", "rel"))
    on = cut(reachable(placed.select("file", "split", "start", F.col("to").alias("succ"), F.col("out").alias("exit"))))
    kept = cut(placed.join(on, ["file", "split", "start"]).where(F.col("to") <= F.col("end")))
    columns = ["file", "start", "type", "id", "url", "date", "refers_to", "payload_bytes", "payload_digest"]
    broken = kept.where("not whole").select("file", "start", "to")
    n = broken.count()
    if not n:
        return kept.select(*columns)
    # records with a magic inside: their bodies are read again and joined up
    # a body belongs to the last record that begins at or before it; only files with such records are looked at
    bodies = placed.join(broken.select("file").distinct(), "file", "left_semi").select("file", "split", "k", "start")
    starts = kept.select("file", "start", F.col("start").alias("owner"), F.col("whole"))
    in_split = bodies.join(starts, ["file", "start"], "left")
    order = Window.partitionBy("file", "split").orderBy("start")
    last = F.last("owner", True).over(order)
    # from split to split only the last record of each matters
    tails = in_split.groupBy("file", "split").agg(F.max("owner").alias("tail")).withColumn("before", F.max("tail").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)))
    owned = in_split.withColumn("owner", last).join(tails.select("file", "split", "before"), ["file", "split"]).withColumn("owner", F.coalesce("owner", "before"))
    within = owned.join(broken.select("file", F.col("start").alias("owner"), "to"), ["file", "owner"]).where("start < to").select("file", "split", "k", F.col("start").alias("at"), "owner")
    within = cut(within)
    numbered = _read_lines(spark, path).mapInArrow(_numbered, "file string, split long, k int, body binary")
    parts = within.count()
    pieces = numbered.join(F.broadcast(within) if parts <= BROADCAST_ROWS else within, ["file", "split", "k"])

    def join_up(pdf: pd.DataFrame) -> pd.DataFrame:
        """One record's bodies."""
        body = MAGIC.encode().join(pdf.sort_values("at")["body"])
        begin, h = _declared(body)
        n, sha1 = _payload(body[begin : begin + int(h["content-length"])], h)
        return pd.DataFrame({"file": [pdf["file"].iloc[0]], "start": [pdf["owner"].iloc[0]], "payload_bytes": [n], "payload_digest": [sha1]})

    joined = pieces.groupBy("file", "owner").applyInPandas(join_up, "file string, start long, payload_bytes long, payload_digest string")
    mended = kept.where("not whole").drop("payload_bytes", "payload_digest").join(joined, ["file", "start"])
    return kept.where("whole").select(*columns).unionByName(mended.select(*columns))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for file, split, bodies in _splits(batches):
        for k, body in enumerate(bodies):
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([split], pa.int64()), pa.array([k], pa.int32()), pa.array([body], pa.binary())], names=["file", "split", "k", "body"])


def page_id(column):
    """The page id in a record id written here; null for none."""
    return F.nullif(F.regexp_extract(column, "^<urn:page:(.*)>$", 1), F.lit(""))


def round_trip(df: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write ``df`` to archives in the shared folder and read them back: id, payload_bytes, payload_digest, record_type, refers_to."""
    path = shared_path(df.sparkSession, "warc")
    write_archives(df, path, id, url, payload, least_bytes)
    back = read_archives(df.sparkSession, path)
    kind = df.schema[id].dataType
    as_id = lambda c: F.url_decode(page_id(F.col(c))).cast(kind)
    return back.select(as_id("id").alias(id), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), as_id("refers_to").alias("refers_to"))
