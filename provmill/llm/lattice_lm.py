"""Corpus language model: likelihood over the lattice of all subword segmentations.

The pieces come from an existing vocabulary.  A text is its words, each led by
a word mark, and an end.  Pieces are drawn independently; a word ends where the
next piece has a mark.  The probability of a word is the sum over all its
segmentations, by the forward recursion in log space.  No piece goes past a
word, so the sum over all segmentations of a text is a product over its words.

The vocabulary's scores are ranks; they give the first weights (a Zipf law).
Expectation maximisation then fits the weights to the distinct words of all
training documents: expected piece counts from the forward and backward
recursions.

Pieces alone can't tell a frequent word from a rare one of the same spelling
pattern, and score worse than word frequencies.  So the lattice of a word that
the training documents have gets one more arc, over the whole word, weighted by
its discounted relative frequency; what the discounts leave (absolute
discounting, from the numbers of words seen once and twice) goes to the pieces.

Training documents may be of several classes (languages).  Each class has its
own weights and word frequencies, and the probability of a text is the mixture
of what the classes give it, weighted by their shares of the training
documents; the class of a text that is scored isn't looked at.

Documents never travel as text.  One pass makes of each batch a block: its
distinct words, and each document as numbers of these.  Words are counted,
scored and looked up in one shuffle by word, where a word is one row a block;
the blocks then meet their documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provmill.llm.common import remembered, text_column, texts, written

#: Upper-case letters to lower case, the six ASCII blanks to a space (fixed values).
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz     ")
MARK = "▁"

#: Words whose lattices are laid out at once, and their letters.
WORDS_AT_ONCE, LETTERS_AT_ONCE = 8192, 200_000
#: Slots of the hash table that holds the trie of the pieces.
SLOTS = 1 << 20
#: Documents and bytes of a block.
BLOCK_ROWS, BLOCK_BYTES = 10_000, 24_000_000


class Pieces:
    """The pieces of a vocabulary file that can occur in a marked word, and the bytes for letters that no piece covers."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        file = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = file.get_piece_size()
        self.byte = [0] * 256
        trie: dict[tuple[int, str], int] = {}
        pieces = [-1]
        usable = np.zeros(self.size, bool)
        for i in range(self.size):
            text = file.id_to_piece(i)
            if file.is_byte(i):
                self.byte[int(text[3:5], 16)] = i
                usable[i] = True
            elif not (file.is_control(i) or file.is_unknown(i) or file.is_unused(i) or MARK in text[1:]):
                node = 0
                for c in text:
                    node = trie.setdefault((node, c), len(pieces))
                    if node == len(pieces):
                        pieces.append(-1)
                pieces[node] = i
                usable[i] = True
        #: Of each trie node its piece, or -1; the trie itself by node and letter, hashed.
        self.piece = np.array(pieces, np.int64)
        self.slot_key, self.slot_node = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, np.int64)
        keys = np.array([node << 21 | ord(c) for node, c in trie], np.int64)
        for key, slot, node in zip(keys.tolist(), _slot(keys).tolist(), trie.values(), strict=True):
            while self.slot_key[slot] >= 0:
                slot = (slot + 1) % SLOTS
            self.slot_key[slot], self.slot_node[slot] = key, node
        rank = np.cumsum(usable)
        first = np.where(usable, 1.0 / (rank + 10), 0)
        self.first = first / first.sum()
        self.usable = usable

    def step(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The trie node after each node and letter; 0 for none."""
        keys = nodes << 21 | letters
        slots = _slot(keys)
        out = np.zeros(len(keys), np.int64)
        left = np.arange(len(keys))
        while len(left):
            there = self.slot_key[slots[left]]
            hit = there == keys[left]
            out[left[hit]] = self.slot_node[slots[left[hit]]]
            left = left[~hit & (there >= 0)]
            slots[left] = (slots[left] + 1) % SLOTS
        return out


def _slot(keys: np.ndarray) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


def _pieces(path: str) -> Pieces:
    return remembered(("pieces", path), lambda: Pieces(path))


class Lattice:
    """All segmentations of some words, as arcs between letter positions."""

    def __init__(self, pieces: Pieces, words: list[str]) -> None:
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        self.pieces, self.nodes = pieces, int((lengths + 1).sum())
        self.last = np.cumsum(lengths + 1) - 1
        self.base = self.last - lengths
        self.level = np.arange(self.nodes) - np.repeat(self.base, lengths + 1)
        # a letter leads on from each node but the last of a word, which has 0, as no piece has
        letters = np.frombuffer("".join(f"{MARK}{w}\0" for w in words).encode("utf-32-le"), "<u4").astype(np.int64)
        inner = np.ones(self.nodes, bool)
        inner[self.last] = False
        at, node, n = np.flatnonzero(inner), None, 0
        starts, ends, ids, self.spelled = [], [], [], []
        while len(at):
            node = pieces.step(np.zeros(len(at), np.int64) if node is None else node, letters[at + n])
            n += 1
            piece = pieces.piece[node]
            found = piece >= 0
            starts.append(at[found])
            ends.append(at[found] + n)
            ids.append(piece[found])
            if n == 1:
                alone = at[~found]
                spelled, which = np.unique(letters[alone], return_inverse=True)
                starts.append(alone)
                ends.append(alone + 1)
                ids.append(which + pieces.size)
                self.spelled = [[pieces.byte[b] for b in chr(c).encode()] for c in spelled.tolist()]
            at, node = at[node > 0], node[node > 0]
        self.starts, self.ends, self.ids = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (starts, ends, ids))
        self.plans: dict[bool, tuple] = {}
        self.weight = np.empty(0)

    def weigh(self, log_p: np.ndarray) -> Lattice:
        """Set the weights of the arcs by those of the pieces: for one class, or (pieces in rows) several at once."""
        spelled = [log_p[b].sum(axis=0) for b in self.spelled]
        self.weight = (np.concatenate([log_p, spelled]) if spelled else log_p)[self.ids]
        return self

    def _plan(self, back: bool) -> tuple:
        """The arcs in the order in which a sweep meets them; the same for all weights."""
        if back not in self.plans:
            source, target, step_of = (self.ends, self.starts, np.repeat(self.last - self.base, self.last - self.base + 1) - self.level) if back else (self.starts, self.ends, self.level)
            order = np.argsort(step_of[target] * self.nodes + target, kind="stable")
            source, target = source[order], target[order]
            first = np.flatnonzero(np.append(True, target[1:] != target[:-1]))  # of each node's arcs
            node = target[first]
            step = step_of[node]
            cuts = np.append(np.flatnonzero(np.append(True, step[1:] != step[:-1])), len(node))
            self.plans[back] = order, source, first, node, cuts, np.append(first, len(target)), np.diff(np.append(first, len(target)))
        return self.plans[back]

    def _sweep(self, back: bool) -> np.ndarray:
        """Log sums over all ways from the words' starts (or back from their ends), level by level."""
        order, source, first, node, cuts, stop, size = self._plan(back)
        total = np.full((self.nodes, *self.weight.shape[1:]), -np.inf)
        total[self.last if back else self.base] = 0
        weight = self.weight[order]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            lo, hi = stop[a], stop[b]
            value = total[source[lo:hi]] + weight[lo:hi]
            bounds = first[a:b] - lo
            peak = np.maximum.reduceat(value, bounds, axis=0)
            value -= np.repeat(peak, size[a:b], axis=0)
            total[node[a:b]] = peak + np.log(np.add.reduceat(np.exp(value), bounds, axis=0))
        return total

    def log_probability(self) -> np.ndarray:
        """Natural log probability of each word; a column for each class."""
        return self._sweep(False)[self.last]

    def expected(self, times: np.ndarray) -> np.ndarray:
        """Expected occurrences of each piece, the words occurring so many times; for the weights of one class."""
        ahead, back = self._sweep(False), self._sweep(True)
        word = np.repeat(np.arange(len(self.base)), self.last - self.base + 1)[self.starts]
        share = np.exp(ahead[self.starts] + self.weight + back[self.ends] - ahead[self.last][word]) * times[word]
        counts = np.bincount(self.ids, share, self.pieces.size + len(self.spelled))
        out = counts[: self.pieces.size].copy()
        for spelling, n in zip(self.spelled, counts[self.pieces.size :], strict=True):
            np.add.at(out, spelling, n)
        return out


def lattices(pieces: Pieces, words: list[str]) -> Iterator[tuple[np.ndarray, Lattice]]:
    """(positions in ``words``, their lattice), words of like length together."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    some: list[int] = []
    letters = 0
    for i in order:
        if some and (len(some) >= WORDS_AT_ONCE or letters + len(words[i]) > LETTERS_AT_ONCE):
            yield np.array(some), Lattice(pieces, [words[k] for k in some])
            some, letters = [], 0
        some.append(i)
        letters += len(words[i]) + 2
    if some:
        yield np.array(some), Lattice(pieces, [words[k] for k in some])


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


def _blocks(df: DataFrame, id: str, text: str, held_out: str, kind: str, kinds: int) -> DataFrame:
    """Rows of two kinds: a block's words (word, at, training occurrences in each class) and its documents (id, held_out, words, at and times packed)."""
    train_names = [f"c{k}" for k in range(kinds)]
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("word", T.StringType()), T.StructField("at", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in train_names), T.StructField("id", df.schema[id].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("size", T.LongType()), T.StructField("body", T.BinaryType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, pack, block = to_arrow_schema(schema), zstandard.ZstdCompressor(level=1).compress, TaskContext.get().partitionId() << 32

        def nulls(n: int, *names: str) -> dict:
            return {x: pa.nulls(n, arrow.field(x).type) for x in names}

        for whole in batches:
            sizes = np.cumsum([len(x) for x in texts(whole, "__text")])
            at = 0
            while at < whole.num_rows:
                stop = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BLOCK_BYTES, side="right"))
                batch = whole.slice(at, max(1, min(stop - at, BLOCK_ROWS)))
                at += batch.num_rows
                number: dict[bytes, int] = {}
                train: list[list[int]] = [[] for _ in range(kinds)]
                held, size, body = batch.column(1).to_pylist(), [], []
                for h, k, t in zip(held, batch.column(2).to_pylist(), texts(batch, "__text"), strict=True):
                    found = words_of(t)
                    size.append(len(found))
                    tally = Counter(found)
                    ids = [number.setdefault(w, len(number)) for w in tally]
                    for row in train:
                        row.extend([0] * (len(number) - len(row)))
                    if not h:
                        row = train[k]
                        for i, n in zip(ids, tally.values(), strict=True):
                            row[i] += n
                    order = np.argsort(ids) if ids else np.empty(0, np.int64)
                    ids_ = np.array(ids, np.uint32)[order]
                    body.append(pack(np.concatenate([np.diff(ids_, prepend=np.uint32(0)), np.fromiter(tally.values(), np.uint32, len(tally))[order]]).astype("<u4").tobytes()))
                n = len(number)
                cols = {"block": pa.array(np.full(n, block)), "word": pa.array([w.decode() for w in number], pa.string()), "at": pa.array(np.arange(n, dtype=np.int32))} | {c: pa.array(row, pa.int64()) for c, row in zip(train_names, train, strict=True)} | nulls(n, "id", "held_out", "size", "body")
                if n:
                    yield pa.RecordBatch.from_arrays([cols[f.name] for f in arrow], schema=arrow)
                n = batch.num_rows
                cols = {"block": pa.array(np.full(n, block)), "id": batch.column(0), "held_out": batch.column(1), "size": pa.array(size, pa.int64()), "body": pa.array(body, pa.binary())} | nulls(n, "word", "at", *train_names)
                yield pa.RecordBatch.from_arrays([cols[f.name].cast(f.type) for f in arrow], schema=arrow)
                block += 1

    return df.select(id, F.col(held_out).cast("boolean"), F.col(kind).cast("int"), text_column(df, text).alias("__text")).mapInArrow(encode, schema)


def fit(words: DataFrame, vocabulary: str, kinds: int, rounds: int, prior: float = 0.01) -> np.ndarray:
    """Natural log probability of each piece in each class, from the distinct words of the whole corpus."""
    pieces = _pieces(vocabulary)
    p = np.tile(pieces.first, (kinds, 1))
    names = [f"c{k}" for k in range(kinds)]
    for _ in range(rounds):
        shared = words.sparkSession.sparkContext.broadcast(np.log(np.maximum(p, 1e-300)))

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            pieces = _pieces(vocabulary)
            total = np.zeros((kinds, pieces.size))
            for batch in batches:
                seen = np.column_stack([batch.column(1 + k).to_numpy(zero_copy_only=False) > 0 for k in range(kinds)])
                for at, lattice in lattices(pieces, batch.column(0).to_pylist()):
                    for k in range(kinds):
                        if seen[at, k].any():
                            total[k] += lattice.weigh(shared.value[k]).expected(seen[at, k].astype(float))
            kind, piece = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[kind, piece])], names=["kind", "piece", "n"])

        known = words.where(" or ".join(f"{c} > 0" for c in names)).select("word", *names)
        if kinds > 1:  # words of one class together: a lattice is only swept for the classes of its words
            known = known.sortWithinPartitions(F.array_position(F.array(*(F.col(c) > 0 for c in names)), True))
        found = known.mapInArrow(expect, "kind int, piece int, n double").groupBy("kind", "piece").agg(F.sum("n").alias("n")).toPandas()  # a row for each class and piece
        counts = np.tile(np.where(pieces.usable, prior, 0.0), (kinds, 1))
        counts[found["kind"].to_numpy(np.int64), found["piece"].to_numpy(np.int64)] += found["n"].to_numpy()
        p = counts / counts.sum(axis=1, keepdims=True)
    return np.log(np.maximum(p, 1e-300))


def scores(df: DataFrame, vocabulary: str, id: str = "doc_id", text: str = "text", held_out: str = "held_out", kind: str | None = None, rounds: int = 2) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score and lattice_score of each row.

    Rows whose ``held_out`` is true aren't learned from (null counts as false).
    ``kind`` names a column with the class of the training rows; all classes are
    told apart, null is one too, and the words' table has a column for each.
    Null and empty texts are the end token alone.  base_score is the smoothed
    word model, lattice_score the lattice of the vocabulary's pieces alone,
    score the lattice with its arcs over whole words, all as log10 probabilities
    of the text's tokens and end; a text's words are what its blanks separate, with
    A-Z in lower case.  An empty table gives an empty result.
    """
    spark = df.sparkSession
    df = df.withColumn("__h", F.coalesce(F.col(held_out), F.lit(False)))
    named = [r[0] for r in df.where(F.col(kind).isNotNull() & ~F.col("__h")).select(F.col(kind).alias("k")).distinct().orderBy("k").collect()] if kind else []
    number = F.lit(len(named))
    for i, value in enumerate(named):
        number = F.when(F.col(kind) == F.lit(value), i).otherwise(number)
    kinds = len(named) + 1
    names = [f"c{k}" for k in range(kinds)]
    blocks = written(_blocks(df.withColumn("__k", number), id, text, "__h", "__k", kinds), "blocks")
    in_blocks = blocks.where("word is not null").select("block", "word", "at", *names)
    documents = blocks.where("word is null").select("block", "id", "held_out", "size", "body")
    words = written(in_blocks.groupBy("word").agg(*(F.sum(c).alias(c) for c in names)), "words")
    facts = words.agg(F.count_if(F.expr("+".join(names)) > 0), *(x for c in names for x in (F.coalesce(F.sum(c), F.lit(0)), F.count_if(F.col(c) > 0), F.count_if(F.col(c) == 1), F.count_if(F.col(c) == 2)))).first()
    texts_of = dict(df.where("not __h").groupBy(number.alias("k")).count().collect())
    per_kind = np.array([texts_of.get(k, 0) for k in range(kinds)], float)
    ends = int(per_kind.sum())
    n, v = sum(facts[1::4]) + ends, facts[0] + (ends > 0)
    shared = spark.sparkContext.broadcast(fit(words, vocabulary, kinds, rounds))
    # in each class: tokens, the discount of each word's count, and the share that the discounts leave to the pieces
    size = np.array(facts[1::4], float) + per_kind
    discount = (np.array(facts[3::4]) + 0.5) / (np.array(facts[3::4]) + 2 * np.array(facts[4::4]) + 1)
    spare = np.where(size > 0, discount * (np.array(facts[2::4]) + (per_kind > 0)) / np.maximum(size, 1), 0.5)
    with np.errstate(divide="ignore"):
        share = np.log10(per_kind / ends) if ends else np.full(kinds, -math.log10(kinds))
        end_lp = np.where(per_kind > 0, np.log10(np.maximum(per_kind - discount, 0) / np.maximum(size, 1)), math.log10(0.5))
    end_share = np.where(per_kind > 0, np.minimum(per_kind / np.maximum(size, 1), 0.5), 0.5)  # of the tokens that the lattice alone draws
    ends_lp = np.concatenate([end_lp, np.log10(end_share)])

    def score_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(vocabulary)
        for batch in batches:
            out = np.zeros((batch.num_rows, kinds))
            used = np.flatnonzero(per_kind > 0) if ends else np.arange(kinds)
            weights = np.ascontiguousarray(shared.value[used].T)
            for at, lattice in lattices(pieces, batch.column(0).to_pylist()):
                out[np.ix_(at, used)] = lattice.weigh(weights).log_probability()
            c = np.column_stack([batch.column(1 + k).to_numpy(zero_copy_only=False) for k in range(kinds)])
            with np.errstate(divide="ignore"):
                whole_word = np.log(np.where(c > 0, c - discount, 0) / np.maximum(size, 1))
            out = np.hstack([np.logaddexp(whole_word, np.log(spare) + out), np.log1p(-end_share) + out]) / math.log(10)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(c.sum(axis=1)), pa.array([r.tobytes() for r in out.astype("<f4")], pa.binary())], names=["word", "c", "lp"])

    scored = words.select("word", *names).mapInArrow(score_words, "word string, c long, lp binary")
    answers = in_blocks.drop(*names).join(scored, "word").select("block", "at", "c", "lp", *(F.lit(None).cast(documents.schema[x].dataType).alias(x) for x in ("id", "held_out", "size", "body")))
    asked = documents.select("block", *(F.lit(None).cast(answers.schema[x].dataType).alias(x) for x in ("at", "c", "lp")), "id", "held_out", "size", "body")
    out = T.StructType([T.StructField(id, df.schema[id].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("lattice_score", T.DoubleType())])
    whole = n + 0.1 * (v + 1)
    base_of = lambda c: np.log10((c + 0.1) / whole)

    def mixed(scores_: np.ndarray) -> float:
        x = scores_ + share
        return float(x.max() + np.log10((10 ** (x - x.max())).sum()))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's words, by number, come before its documents."""
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, unpack = to_arrow_schema(out), zstandard.ZstdDecompressor().decompress
        end_base = float(base_of(ends))

        def runs():
            for batch in batches:
                key = batch.column(0).to_numpy(zero_copy_only=False)
                cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if b > a:
                        yield int(key[a]), batch.slice(a, b - a)

        for _, parts in groupby(runs(), key=lambda r: r[0]):
            held: list = []
            table = None
            for _, part in parts:
                is_word = part.column(1).is_valid().to_numpy(zero_copy_only=False)
                k = int(is_word.sum())
                if k:
                    held.append((part.column(2).slice(0, k).to_numpy(zero_copy_only=False), np.frombuffer(b"".join(part.column(3).slice(0, k).to_pylist()), "<f4").reshape(k, 2 * kinds).astype(np.float64)))
                rest = part.slice(k)
                if not rest.num_rows:
                    continue
                if table is None:
                    table = [np.concatenate(x) for x in zip(*held, strict=True)] if held else [np.empty(0), np.empty((0, 2 * kinds))]
                    known, base, lp = table[0] > 0, base_of(table[0]), table[1]
                rows = []
                for body in rest.column(7):
                    raw = np.frombuffer(unpack(body.as_py()), "<u4")
                    at, times = np.cumsum(raw[: len(raw) // 2], dtype=np.int64), raw[len(raw) // 2 :].astype(np.float64)
                    both = times @ lp[at] + ends_lp if len(at) else ends_lp
                    rows.append((int(times[known[at]].sum() if len(at) else 0) + (ends > 0), (times @ base[at] if len(at) else 0) + end_base, mixed(both[:kinds]), mixed(both[kinds:])))
                size = rest.column(6).to_numpy(zero_copy_only=False)
                cols = [rest.column(4), rest.column(5), size + 1, [r[0] for r in rows], np.full(len(rows), n), [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows]]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    # a block a task, whatever the number of blocks
    tasks, most = documents.agg(F.coalesce(F.max(F.shiftright("block", 32)), F.lit(0)) + 1, F.coalesce(F.max(F.col("block").bitwiseAND(0xFFFFFFFF)), F.lit(0)) + 1).first()
    place = F.shiftright("block", 32) * most + F.col("block").bitwiseAND(0xFFFFFFFF)
    return answers.unionAll(asked).repartitionById(tasks * most, place.cast("int")).sortWithinPartitions("block", F.asc_nulls_last("at")).mapInArrow(total, out)
