"""Language identification: words first, then ever shorter character n-grams.

A word that the model knows is scored by its log frequency in each language.
Any other word is scored by the mean over its n-grams, of the longest order of
which the model knows one.  A text's scores are the sums over its words; their
softmax is the score, the softmax of their means over the words the confidence.

Frequencies are smoothed so that languages with much and with little training
text compare: each is drawn towards one background that all share, with the
weight of ``prior`` units.  A language that has seen little stays close to the
background and gains nothing from what it hasn't seen.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provmill.llm.common import arrow_map, remembered, text_column, texts

_WORD = re.compile(r"[^\W\d_]+")
_numbers = count()

UNKNOWN = "und"


class Names:
    """Numbers of distinct strings, in arrays: a number is found by the string's hash, then the strings are compared."""

    def __init__(self, names: pa.Array, first: int = 0) -> None:
        """The string at place i has the number ``first`` + i."""
        hashes = self._hashes(names.to_pylist())
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.numbers, self.names = hashes[order], (order + first).astype(np.int32), names.take(pa.array(order))

    @staticmethod
    def _hashes(names: list[str]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))

    def find(self, names: list[str]) -> np.ndarray:
        """The number of each of ``names``, -1 for those that aren't there."""
        out = np.full(len(names), -1, np.int64)
        if not len(self.hashes) or not names:
            return out
        hashes = self._hashes(names)
        at, left, asked = np.searchsorted(self.hashes, hashes), np.arange(len(names)), pa.array(names, pa.string())
        while True:  # once, but for strings of equal hashes
            left = left[at[left] < len(self.hashes)]
            left = left[self.hashes[at[left]] == hashes[left]]
            if not len(left):
                return out
            same = pc.equal(self.names.take(pa.array(at[left])), asked.take(pa.array(left))).to_numpy(zero_copy_only=False)
            out[left[same]] = self.numbers[at[left[same]]]
            left = left[~same]
            at[left] += 1


@dataclass
class Model:
    """Words and n-grams of the sample with their scores; a column of scores for each language."""

    langs: list[str]
    words: Names
    grams: Names
    scores: np.ndarray  # a row for each word and n-gram
    orders: tuple[int, ...]


def _counted(rows: DataFrame, orders: tuple[int, ...]) -> DataFrame:
    """(lang, order, unit, n): counts of words (order 0) and n-grams, merged within a batch first."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: dict[str, Counter] = {}
            for lang, t in zip(batch.column(0).to_pylist(), texts(batch, "__text"), strict=True):
                words.setdefault(lang, Counter()).update(_WORD.findall(t.lower()))
            for lang, by_word in words.items():
                units: Counter = Counter({(0, w): n for w, n in by_word.items()})
                for w, n in by_word.items():
                    framed = f" {w} "
                    for k in orders:
                        for i in range(len(framed) - k + 1):
                            units[k, framed[i : i + k]] += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(units), pa.string()), pa.array([u[0] for u in units], pa.int32()), pa.array([u[1] for u in units], pa.string()), pa.array(list(units.values()), pa.int64())], names=["lang", "order", "unit", "n"]
                )

    return rows.mapInArrow(tally, "lang string, order int, unit string, n long").groupBy("lang", "order", "unit").agg(F.sum("n").alias("n"))


def smoothed(counts: np.ndarray, prior: float) -> np.ndarray:
    """Log frequencies of the units of one order; rows are units, columns languages.

    Each language's frequencies are first drawn towards the pooled ones; the
    mean of what results is the background that they are then drawn towards.
    """
    sizes = counts.sum(axis=0)
    pooled = counts.sum(axis=1, keepdims=True) / max(1, sizes.sum())
    background = ((counts + prior * pooled) / (sizes + prior)).mean(axis=1, keepdims=True)
    return np.log((counts + prior * background) / (sizes + prior))


def train(df: DataFrame, lang: str = "lang", text: str = "text", id: str = "doc_id", rows: int = 6000, orders: tuple[int, ...] = (5, 4, 3, 2, 1), prior: float = 1000.0) -> Model:
    """Fit on about ``rows`` labelled rows: those with the lowest hashes of their ids.

    The sample's size doesn't depend on the table's.  All languages, words and
    n-grams of the sample are learned; the model's table has one number for each
    unit and language.  Rows without a language or text are left out; a null id
    counts as an id.
    """
    labelled = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    n = labelled.count()
    share = min(1.0, rows / n) if n else 1.0
    place = F.pmod(F.xxhash64(F.col(id).cast("string")), F.lit(1_000_003))
    sample = labelled.where(place < math.ceil(share * 1_000_003)).select(F.col(lang).cast("string").alias("lang"), text_column(df, text).alias("__text"))
    found = _counted(sample, orders).orderBy("order", "unit", "lang").toArrow()
    order = found["order"].to_numpy()
    unit = found["unit"].combine_chunks()
    langs = sorted(set(found["lang"].unique().to_pylist()))
    at = pc.index_in(found["lang"], pa.array(langs, pa.string())).to_numpy()
    new = np.append(True, (order[1:] != order[:-1]) | pc.not_equal(unit[1:], unit[:-1]).to_numpy(zero_copy_only=False))[: len(found)]
    counts = np.zeros((int(new.sum()), max(1, len(langs))), np.float64)
    np.add.at(counts, (np.cumsum(new) - 1, at), found["n"].to_numpy().astype(np.float64))
    order, names = order[new], unit.filter(pa.array(new))
    del found, unit, at
    scores = np.zeros(counts.shape, np.float32)
    for k in (0, *orders):
        of = order == k
        if of.any():
            scores[of] = smoothed(counts[of], prior)
    # words come first: order 0
    n_words = int((order == 0).sum())
    return Model(langs, Names(names[:n_words]), Names(names[n_words:], n_words), scores, orders)


class Scorer:
    """Scores texts; words once met are remembered up to a bound."""

    MOST = 300_000

    def __init__(self, model: Model) -> None:
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.row: dict[str, int] = {}
        self.unknown = np.zeros((self.MOST, self.model.scores.shape[1]), np.float32)
        self.used = 0

    def unseen(self, words: list[str]) -> np.ndarray:
        """Scores of words that the model doesn't know, a row for each."""
        out, left = np.zeros((len(words), self.model.scores.shape[1]), np.float32), list(range(len(words)))
        for k in self.model.orders:
            grams, owners = [], []
            for i in left:
                framed = f" {words[i]} "
                made = [framed[j : j + k] for j in range(len(framed) - k + 1)]
                grams += made
                owners += [i] * len(made)
            rows = self.model.grams.find(grams)
            known = rows >= 0
            rows, owners = rows[known], np.array(owners, np.int64)[known]
            if len(rows):
                starts = np.flatnonzero(np.append(True, owners[1:] != owners[:-1]))
                n = np.diff(np.append(starts, len(owners)))
                out[owners[starts]] = np.add.reduceat(self.model.scores[rows], starts, axis=0) / n[:, None]
                done = set(owners[starts].tolist())
                left = [i for i in left if i not in done]
            if not left:
                break
        return out

    def learn(self, words: list[str]) -> None:
        """Remember the scores of distinct words that weren't met yet."""
        numbers = self.model.words.find(words)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            self.unknown[self.used : self.used + len(new)] = self.unseen([words[i] for i in new])
            numbers[new] = len(self.model.scores) + self.used + np.arange(len(new))
            self.used += len(new)
        self.row.update(zip(words, numbers.tolist(), strict=True))

    def total(self, words: list[str]) -> np.ndarray:
        """Sums of the scores of so many words as are remembered at most."""
        rows = list(map(self.row.get, words))
        if None in rows:
            new = [w for w in dict.fromkeys(words) if w not in self.row]
            if len(self.row) + len(new) > self.MOST:
                self.forget()
                new = list(dict.fromkeys(words))
            self.learn(new)
            rows = list(map(self.row.get, words))
        rows, n = np.array(rows, np.int64), len(self.model.scores)
        known = rows < n
        return self.model.scores[rows[known]].sum(axis=0, dtype=np.float64) + self.unknown[rows[~known] - n].sum(axis=0, dtype=np.float64)

    def predict(self, text: str) -> tuple[str, float, float]:
        """Language, score and confidence."""
        words = _WORD.findall(text.lower())
        if not words or not self.model.langs:
            return UNKNOWN, 0.0, 0.0
        total = sum(self.total(words[i : i + self.MOST]) for i in range(0, len(words), self.MOST))
        best = int(total.argmax())
        behind = total - total[best]
        return self.model.langs[best], float(1 / np.exp(behind).sum()), float(1 / np.exp(behind / len(words)).sum())


def predict(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, lang_pred, score and confidence (0 to 1) of each row, from the text alone.

    ``score`` is how certain the language of the whole text is, so it nears 1
    with the text's length; ``confidence`` is the same of a word of the text,
    whatever its length.  Null texts and texts without a letter are ``und`` with
    both 0, as is every text if the model has learned nothing; of languages with
    equal scores the first by name is taken.
    """
    sc = df.sparkSession.sparkContext
    shared, key = sc.broadcast(model), f"language-{sc.applicationId}-{next(_numbers)}"
    schema = T.StructType([df.schema[k] for k in keep]).add("lang_pred", "string").add("score", "double").add("confidence", "double")

    def make(batch: pa.RecordBatch) -> dict:
        scorer = remembered(key, lambda: Scorer(shared.value))
        found = [scorer.predict(t) for t in texts(batch, "__text")]
        return {k: batch.column(i) for i, k in enumerate(keep)} | dict(zip(("lang_pred", "score", "confidence"), map(list, zip(*found, strict=True)), strict=True))

    return arrow_map(df.select(*keep, text_column(df, text).alias("__text")), make, schema)
