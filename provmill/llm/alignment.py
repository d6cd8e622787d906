"""Alignment of two tokenizers over a corpus by counts of tokens that end together.

A text's tokens of both vocabularies are laid over its bytes.  Where tokens of
both end, the text is cut into groups, and the two tokens that end there are
linked.  How often the corpus links a pair of ids tells which id of the first
vocabulary is the best counterpart of one of the second.

A white-space run after another character starts a new group in both
vocabularies whatever came before (but for characters that a piece joins to
what precedes them, which is read from the vocabulary), so texts are cut into
units there and a worker remembers units.

Counting is striped by the second id.  Map tasks gather links in chunks, drop
repetitions, and write for each chunk and stripe the pairs, how often each
occurs, and the documents they occur in.  Only pairs and counts travel to the
counting tasks: a stripe is a dense matrix (second ids by first ids), to which
``np.add.at`` adds them, and the rows' maxima name the best.  Scoring is
partitioned the same way: a stripe's counts are laid out once, its links stream
by, and sums by document are added up.  A stripe with many links is dealt to
several tasks, each with the counts.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provmill.llm.common import remembered, text_column, texts, written
from provmill.llm.token_counts import SPACE, byte_symbols

#: Second ids are dealt to so many stripes: a matrix of 32,000 by 50,000 ids takes 50 MB a stripe.
STRIPES = 256
#: Links and documents of a chunk, units a worker remembers and the longest of them in characters.
CHUNK_LINKS, CHUNK_DOCS, MOST_UNITS, LONGEST_UNIT = 1_000_000, 60_000, 400_000, 64
#: Units looked up at once, and characters of them, so that a long text isn't laid out whole.
SLICE, LONGEST_SLICE = 200_000, 1_000_000

#: The pre-token rule of byte-level BPE vocabularies of this family (fixed value).
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_BAD = np.iinfo(np.int64).min


class Aligner:
    """Links and groups of texts under two vocabularies; the first by ``tokenizers``, the second by ``sentencepiece``."""

    def __init__(self, first: str, second: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        back = {s: b for b, s in byte_symbols().items()}
        vocabulary = Tokenizer.from_file(first).get_vocab()
        self.width = max(vocabulary.values()) + 1
        self.a_bytes: list[bytes] = [b""] * self.width
        ranks = {}  # ids are in the order of merges; special tokens aren't among them, so that their strings are plain text
        for token, i in vocabulary.items():
            if all(c in back for c in token) and not token.startswith("<|"):
                self.a_bytes[i] = bytes(back[c] for c in token)
                ranks[self.a_bytes[i]] = i
        self.a = tiktoken.Encoding("first", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens={})
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        plain = [p.replace("▁", " ") for i, p in enumerate(pieces) if not self.b.is_byte(i)]
        if any("\n" in p for p in plain):
            raise ValueError("pieces with line ends aren't supported")  # learn() relies on it
        joined = "".join(sorted({c for p in plain for c in re.findall(f"[^{SPACE}]([{SPACE}])", p)}))
        self.unit = re.compile(f"[{SPACE}]*[^{SPACE}]+" + (f"(?:[{re.escape(joined)}][{SPACE}]*[^{SPACE}]*)*" if joined else "") + f"|[{SPACE}]+")
        self.space = re.compile(f"[{SPACE}]")
        self.a_length, self.b_length = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.a_text, self.b_text = [str(i) for i in range(self.width)], [str(i) for i in range(len(pieces))]
        self.known: dict[str, tuple[bytes, str]] = {}
        self.before: dict[str, tuple[bytes, str]] = {}  # what was known when half of the bound was reached last

    def learn(self, keys: list[str]) -> None:
        """Remember, of each unit, a number that holds the counts of tokens, then the links, as 64-bit integers; and the groups.

        Units side by side have the tokens that they have apart.  A line end
        before the first keeps the prefix that the second library adds apart.
        """
        if not keys:
            return
        units = [k if self.space.match(k) else " " + k for k in keys]
        text = "".join(units)
        whole = text.encode()
        a, b = self.a.encode_ordinary(text), self.b.encode("\n" + text, num_threads=1)[2:]
        if b"".join(map(self.a_bytes.__getitem__, a)) != whole or b"".join(map(self.b_bytes.__getitem__, b)) != whole:
            if len(keys) == 1:
                self.known[keys[0]] = array("q", [_BAD]).tobytes(), ""
            else:
                self.learn(keys[: len(keys) // 2])
                self.learn(keys[len(keys) // 2 :])
            return
        ids_a, ids_b = np.array(a, np.int64), np.array(b, np.int64)
        ends, last_a, last_b = np.intersect1d(self.a_length[ids_a].cumsum(), self.b_length[ids_b].cumsum(), assume_unique=True, return_indices=True)
        links = ids_b[last_b] * self.width + ids_a[last_a]
        lengths = [len(u) for u in units] if text.isascii() else [len(u.encode()) for u in units]
        cuts = np.searchsorted(ends, np.cumsum(lengths)) + 1  # the last group of each unit, exclusive
        after_a, after_b = (last_a[cuts - 1] + 1, last_b[cuts - 1] + 1)
        headers = -1 - (np.diff(after_a, prepend=0) << 31 | np.diff(after_b, prepend=0))
        numbers = np.insert(links, np.concatenate([[0], cuts[:-1]]), headers).tobytes()
        text_a, text_b = [self.a_text[i] for i in a], [self.b_text[i] for i in b]
        i = j = 0
        groups = []
        for p, q in zip((last_a + 1).tolist(), (last_b + 1).tolist(), strict=True):
            groups.append(f"{text_a[i] if p == i + 1 else ','.join(text_a[i:p])}|{text_b[j] if q == j + 1 else ','.join(text_b[j:q])}")
            i, j = p, q
        lo = 0
        for n, (k, hi) in enumerate(zip(keys, cuts.tolist(), strict=True)):
            self.known[k] = numbers[8 * (lo + n) : 8 * (hi + n + 1)], ";".join(groups[lo:hi])
            lo = hi

    def keys(self, text: str) -> Iterator[list[str]]:
        """The units of a space and ``text``, in lists of bounded length; where a unit has one space before it, that may be left out."""
        if len(text) < LONGEST_SLICE:
            words = text.split()
            if " ".join(words) == text.replace("\n", " "):  # no white space but single spaces and line ends between words
                yield text.replace("\n", " \n").split(" ") if "\n" in text else words
                return
        found = (m[0] for m in self.unit.finditer(" " + text))
        while some := list(islice(found, SLICE)):
            yield some

    def entries(self, keys: list[str]) -> list[tuple[bytes, str]]:
        missing = {*keys}.difference(self.known)
        if missing:
            if len(self.known) + len(missing) > MOST_UNITS // 2:
                self.before, self.known = self.known, {}
                missing = {*keys}
            for k in self.before.keys() & missing:
                self.known[k] = self.before[k]
                missing.discard(k)
            alone = [k for k in missing if self.space.match(k[-1])]  # white space at an end could join what follows
            for k in alone:
                self.learn([k])
            self.learn(list(missing.difference(alone)))
        out = list(map(self.known.__getitem__, keys))
        for k in missing:
            if len(k) > LONGEST_UNIT:
                del self.known[k]
        return out

    def align(self, text: str) -> tuple[int, int, np.ndarray, str]:
        """(tokens of the first, of the second, links as second id * width + first id, SHA-256 of the groups).

        Without tokens (empty, or bytes that don't come back): 0, 0, none, "".
        """
        n_a = n_b = 0
        links, sha = [], hashlib.sha256()
        for keys in self.keys(text) if text else ():
            got = self.entries(keys)
            numbers = np.frombuffer(b"".join([g[0] for g in got]), np.int64)
            counts = -1 - numbers[numbers < 0]
            if counts.max(initial=0) > 1 << 62:
                return 0, 0, np.empty(0, np.int64), ""
            n_a += int((counts >> 31).sum())
            n_b += int((counts & (1 << 31) - 1).sum())
            groups = ";".join([g[1] for g in got])
            sha.update((";" + groups if links else groups).encode())
            links.append(numbers[numbers >= 0])
        return (n_a, n_b, np.concatenate(links), sha.hexdigest()) if links else (0, 0, np.empty(0, np.int64), "")


def _small(numbers: np.ndarray) -> bytes:
    """Numbers in the narrowest unsigned type."""
    return numbers.astype(np.min_scalar_type(int(numbers.max(initial=0)))).tobytes()


def _large(data: bytes, many: int) -> np.ndarray:
    """Back from ``_small``."""
    return np.frombuffer(data, f"<u{len(data) // many}").astype(np.int64) if many else np.empty(0, np.int64)


def _blocks(links: list[np.ndarray], docs: list[int], rows: int, width: int) -> Iterator[tuple]:
    """(stripe, links, pairs, totals, documents a pair, documents, times) of a chunk's links.

    A pair is its place in the stripe's matrix, a document its place in the chunk.
    """
    code = np.concatenate(links)
    b, a = np.divmod(code, width)
    key = ((b % STRIPES * rows + b // STRIPES) * width + a) << 16 | np.repeat(np.array(docs, np.int64), [len(x) for x in links])
    key, times = np.unique(key, return_counts=True)
    pair, doc = key >> 16, key & 0xFFFF
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    totals, per = np.add.reduceat(times, first) if len(first) else times, np.diff(first, append=len(pair))
    pair = pair[first]
    stripe = pair // (rows * width)
    edges = np.searchsorted(stripe, np.arange(STRIPES + 1))
    link_edges = np.append(first, len(doc))[edges]
    for s in np.unique(stripe):
        (lo, hi), (l, h) = edges[s : s + 2], link_edges[s : s + 2]
        yield int(s), int(h - l), (pair[lo:hi] - s * rows * width).astype("<u4").tobytes(), _small(totals[lo:hi]), _small(per[lo:hi]), doc[l:h].astype("<u2").tobytes(), _small(times[l:h])


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_BLOCK = ("weight", "pairs", "totals", "per", "docs", "times")


def linked(df: DataFrame, first: str, second: str, rows: int, width: int, id: str = "doc_id", text: str = "text", chunk_links: int = CHUNK_LINKS) -> DataFrame:
    """A row a document (``stripe`` null) and a row for each chunk and stripe, as ``_blocks`` has them."""
    schema = T.StructType([df.schema[id]]).add("chunk", "long").add("local", "integer")
    for c in _COUNTS:
        schema.add(c, "long")
    schema = schema.add("groups_sha256", "string").add("stripe", "integer").add("weight", "long")
    for c in _BLOCK[1:]:
        schema.add(c, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        aligner = remembered(("aligner", first, second), lambda: Aligner(first, second))
        chunk, local, waiting, full, links, docs = TaskContext.get().partitionId() << 32, 0, 0, False, [], []

        def made(n: int, columns: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns.get(f.name), pa.Array) else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in arrow], schema=arrow)

        def blocks() -> Iterator[pa.RecordBatch]:
            nonlocal waiting
            if links:
                made_of = list(zip(*_blocks(links, docs, rows, width), strict=True))
                yield made(len(made_of[0]), {"chunk": [chunk] * len(made_of[0]), **dict(zip(("stripe", *_BLOCK), made_of, strict=True))})
            links.clear()
            docs.clear()
            waiting = 0

        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("chunk", "local", *_COUNTS, "groups_sha256")}
            for t in texts(batch, "__text"):
                n_a, n_b, found, sha = aligner.align(t)
                for c, v in zip(out, (chunk, local, n_a, n_b, len(found), len(found), sha), strict=True):
                    out[c].append(v)
                for k in range(0, len(found), chunk_links):  # a very long text's links go in parts
                    links.append(found[k : k + chunk_links])
                    docs.append(local)
                    waiting += len(links[-1])
                    if waiting >= chunk_links:
                        yield from blocks()
                        full = True
                local += 1
                if full or local == CHUNK_DOCS:
                    yield from blocks()
                    chunk, local, full = chunk + 1, 0, False
            if batch.num_rows:
                yield made(batch.num_rows, {id: batch.column(0), **out})
        yield from blocks()

    return df.select(id, text_column(df, text).alias("__text")).mapInArrow(run, schema)


def sizes(first: str, second: str) -> tuple[int, int]:
    """Rows and columns of a stripe's matrix."""
    import sentencepiece
    from tokenizers import Tokenizer

    return (sentencepiece.SentencePieceProcessor(model_file=second).get_piece_size() - 1) // STRIPES + 1, max(Tokenizer.from_file(first).get_vocab().values()) + 1


def counted(blocks: DataFrame, rows: int, width: int) -> DataFrame:
    """(stripe, pairs, counts, best) of each second id: its pairs, how often the corpus links them, whether no other of the id is linked more often."""
    schema = T.StructType().add("stripe", "integer").add("pairs", "binary").add("counts", "binary").add("best", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        block, at = np.zeros((rows, width), np.int64), None
        flat = block.reshape(-1)

        def finished() -> Iterator[pa.RecordBatch]:
            most = block.max(axis=1)
            for r in np.flatnonzero(most):
                a = np.flatnonzero(block[r])
                n = block[r, a]
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((at, (r * width + a).astype("<u4").tobytes(), n.tobytes(), (n == most[r]).tobytes()), arrow, strict=True)], schema=arrow)
            block[most > 0] = 0

        for batch in batches:
            for stripe, pairs, totals in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if stripe != at:
                    yield from finished()
                    at = stripe
                where = np.frombuffer(pairs, "<u4")
                np.add.at(flat, where, _large(totals, len(where)))
        yield from finished()

    return blocks.select("stripe", "pairs", "totals").repartition("stripe").sortWithinPartitions("stripe").mapInArrow(run, schema)


def scored(blocks: DataFrame, counts: DataFrame, rows: int, width: int) -> DataFrame:
    """(chunk, local, n_best, count_sum): sums by document, one row or more for each with links.

    A stripe's links go to as many tasks as their share of all links asks for,
    the stripe's counts to each of those.
    """
    spark = blocks.sparkSession
    weights = dict(blocks.groupBy("stripe").agg(F.sum("weight")).collect())  # a row a stripe
    share = max(1, sum(weights.values()) // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    tasks = F.element_at(F.lit([-(-weights.get(s, 1) // share) for s in range(STRIPES)]), F.col("stripe") + 1)
    none = lambda kind, *names: (F.lit(None).cast(kind).alias(n) for n in names)
    laid = counts.select("stripe", F.explode(F.sequence(F.lit(0).cast("long"), tasks.cast("long") - 1)).alias("salt"), *none("long", "chunk"), "pairs", "counts", "best", *none("binary", *_BLOCK[3:]))
    passing = blocks.select("stripe", F.pmod(F.xxhash64("chunk"), tasks.cast("long")).alias("salt"), "chunk", "pairs", *none("binary", "counts", "best"), *_BLOCK[3:])
    together = laid.unionByName(passing).repartition("stripe", "salt").sortWithinPartitions("stripe", "salt", F.col("chunk").isNotNull())
    schema = T.StructType().add("chunk", "long").add("local", "integer").add("n_best", "long").add("count_sum", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        count, is_best, at, touched = np.zeros(rows * width, np.int64), np.zeros(rows * width, bool), None, []
        sums: dict[int, np.ndarray] = {}
        held = 0

        def added() -> Iterator[pa.RecordBatch]:
            for chunk, (best, total) in sums.items():
                local = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((np.full(len(local), chunk), local.astype(np.int32), best[local], total[local]), arrow, strict=True)], schema=arrow)
            sums.clear()

        for batch in batches:
            for stripe, salt, chunk, pairs, counts, best, per, docs, times in zip(*batch.columns, strict=True):
                where = np.frombuffer(pairs.as_buffer(), "<u4")
                if (stripe, salt) != at:
                    for w in touched:
                        count[w], is_best[w] = 0, False
                    at, touched = (stripe, salt), []
                if not chunk.is_valid:
                    count[where], is_best[where] = np.frombuffer(counts.as_buffer(), np.int64), np.frombuffer(best.as_buffer(), bool)
                    touched.append(where)
                    continue
                doc = np.frombuffer(docs.as_buffer(), "<u2")
                often = _large(times.as_py(), len(doc))
                pair = np.repeat(where, _large(per.as_py(), len(where)))
                key, need = chunk.as_py(), int(doc.max()) + 1
                own = sums.get(key)
                if own is None or own.shape[1] < need:
                    grown = np.zeros((2, max(need, 1024)), np.int64)
                    if own is not None:
                        grown[:, : own.shape[1]] = own
                        held -= own.size
                    sums[key] = own = grown
                    held += own.size
                np.add.at(own[0], doc, often * is_best[pair])
                np.add.at(own[1], doc, often * count[pair])
                if held > 2_000_000:
                    yield from added()
                    held = 0
        yield from added()

    return together.mapInArrow(run, schema)


def aligned(df: DataFrame, first: str, second: str, id: str = "doc_id", text: str = "text", chunk_links: int = CHUNK_LINKS) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row.

    Tokens of a space and the text by ``first`` and of the text by ``second``
    (which adds the space), special tokens' strings as plain text.  A link
    joins two tokens that end at one place; it is best if no other first id is
    linked more often to its second id in the whole table.  Null and empty
    texts, and texts whose bytes one of the vocabularies doesn't give back, have
    zeros and an empty ``groups_sha256``, and link nothing.  Repeated rows count
    each.  Other columns are left out, whatever their names.
    """
    rows, width = sizes(first, second)
    table = written(linked(df, first, second, rows, width, id, text, chunk_links), "links")
    blocks, docs = table.where("stripe is not null"), table.where("stripe is null")
    counts = written(counted(blocks, rows, width), "pair-counts")
    zero = F.lit(0).cast("long")
    own = docs.select("chunk", "local", id, *_COUNTS, "groups_sha256", zero.alias("n_best"), zero.alias("count_sum"))
    partial = scored(blocks, counts, rows, width).select("chunk", "local", F.lit(None).cast(df.schema[id].dataType).alias(id), *(zero.alias(c) for c in _COUNTS), F.lit(None).cast("string").alias("groups_sha256"), "n_best", "count_sum")
    sums = [F.sum(c).alias(c) for c in (*_COUNTS, "n_best", "count_sum")]
    return own.unionByName(partial).groupBy("chunk", "local").agg(F.max(id).alias(id), F.max("groups_sha256").alias("groups_sha256"), *sums).select(id, *_COUNTS, "n_best", "count_sum", "groups_sha256")
