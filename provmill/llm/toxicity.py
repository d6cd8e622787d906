"""Toxicity by cumulative-link ordinal regression on sparse text features.

A document has a severity grade 0 < 1 < ... < K.  One weight vector is shared by
all thresholds: P(grade > k) = sigmoid(w.x - t_k) with t_0 < t_1 < ..., and the
severity that is reported is the expected grade, the sum of these over k.

Labels are 0 or 1.  The grades above 0 are quantile bands, over the labelled
toxic rows, of the density of strongly toxic features (those found in a share
of the toxic rows that is over ten times their share of the clean ones); with
one band the model is a plain logistic regression.  So a severity above 1 says
how densely a text is toxic, not how grave a reader would find it.

Features are words and their first letters (so that inflected forms share
one), chosen by how strongly presence and label go together.
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
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provmill.llm.common import arrow_map, cut, remembered, text_column, texts, written

_WORD = re.compile(r"[^\W\d_]+")
_numbers = count()

#: Letters of the prefix features, besides the whole word.
PREFIXES = (4, 5)


def word_features(word: str) -> tuple[str, ...]:
    return (word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n))


@dataclass
class Model:
    """weights: by feature, on log(1 + occurrences); thresholds: ascending."""

    features: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, margin: np.ndarray) -> np.ndarray:
        """P(grade > k) of each row, a column for each k."""
        return 1 / (1 + np.exp(-np.clip(margin[:, None] - self.thresholds[None, :], -40, 40)))


class Extractor:
    """Occurrences of the model's features in a text."""

    MOST = 300_000

    def __init__(self, features: dict[str, int]) -> None:
        self.features, self.known = features, {}

    def of(self, word: str) -> tuple[int, ...]:
        if len(self.known) >= self.MOST:
            self.known.clear()
        found = self.known[word] = tuple(i for f in word_features(word) if (i := self.features.get(f)) is not None)
        return found

    def counts(self, text: str) -> tuple[Counter, int]:
        out: Counter = Counter()
        known, words = self.known, _WORD.findall(text.lower())
        for w in words:
            found = known.get(w)
            if found is None:
                found = self.of(w)
            if found:
                out.update(found)
        return out, len(words)


def _fit(x: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, width: int, grades: np.ndarray, top: int, l2: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam on the penalised mean log likelihood; x: rows, columns, values."""
    rows, cols, vals = x
    w = np.zeros(width)
    share = [(grades > k).mean() for k in range(top)]
    t = np.array([math.log((1 - s + 1e-3) / (s + 1e-3)) for s in share])
    raw = np.concatenate([t[:1], np.log(np.maximum(np.diff(t), 1e-3))])  # gaps stay positive
    theta = np.concatenate([w, raw])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for i in range(1, steps + 1):
        w, raw = theta[:width], theta[width:]
        t = raw[0] + np.concatenate([[0], np.cumsum(np.exp(raw[1:]))])
        margin = np.bincount(rows, vals * w[cols], n)
        # P(grade = g) = S(g-1) - S(g), S(k) = P(grade > k)
        s = np.hstack([np.ones((n, 1)), sig(margin[:, None] - t[None, :]), np.zeros((n, 1))])
        at = np.arange(n)
        hi, lo = s[at, grades], s[at, grades + 1]
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        g_margin = -(d_hi - d_lo) / n
        g_t = np.array([(np.where(grades == k + 1, d_hi, 0) - np.where(grades == k, d_lo, 0)).sum() / n for k in range(top)])
        g_raw = np.concatenate([[g_t.sum()], [g_t[k:].sum() * np.exp(raw[k]) for k in range(1, top)]])
        g = np.concatenate([np.bincount(cols, vals * g_margin[rows], width) + l2 * w, g_raw])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    w, raw = theta[:width], theta[width:]
    return w, raw[0] + np.concatenate([[0], np.cumsum(np.exp(raw[1:]))])


def train(df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = 8000, features: int = 3000, bands: int = 2, l2: float = 1e-5, steps: int = 250) -> Model | None:
    """Fit on about ``rows`` labelled documents: those with the lowest hashes of their ids.

    Null ids and labels are left out; of several labels of a document the
    highest counts, of several texts of an id the last in order.  None if the sample doesn't have rows of both kinds.
    """
    spark = df.sparkSession
    known = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id).alias("__id")).agg(F.max((F.col(label) > 0).cast("int")).alias("__y"))
    n = known.count()
    share = min(1.0, rows / n) if n else 1.0
    # bounded by ``rows``, whatever the size of the labels
    chosen = known.where(F.pmod(F.xxhash64(F.col("__id").cast("string")), F.lit(1_000_003)) < math.ceil(share * 1_000_003))
    sample = df.select(F.col(id).alias("__id"), text_column(df, text).alias("__text")).join(F.broadcast(chosen), "__id").groupBy("__id").agg(F.first("__y").alias("__y"), F.max("__text").alias("__text")).select("__y", "__text")
    sample = cut(sample)

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tally = (Counter(), Counter())
            y = batch.column(0).to_pylist()
            for label_, t in zip(y, texts(batch, "__text"), strict=True):
                tally[label_].update({f for w in set(_WORD.findall(t.lower())) for f in word_features(w)})
            tally[0][""] += y.count(0)
            tally[1][""] += y.count(1)
            names = list(tally[0].keys() | tally[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([tally[0][f] for f in names], pa.int64()), pa.array([tally[1][f] for f in names], pa.int64())], names=["f", "clean", "toxic"])

    seen = written(sample.mapInArrow(presence, "f string, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "presence")
    base = seen.where("f = ''").first()
    if base is None or not base["clean"] or not base["toxic"]:
        return None
    a, b = F.col("toxic"), F.col("clean")
    all_toxic, all_clean = F.lit(float(base["toxic"])), F.lit(float(base["clean"]))
    total, present = all_toxic + all_clean, a + b
    # the chi-square statistic of presence and label
    odd = total * F.pow(a * (all_clean - b) - b * (all_toxic - a), 2) / (all_toxic * all_clean * present * (total - present + 0.5))
    strong = a / all_toxic > 10 * (b + 0.5) / all_clean
    best = seen.where("f <> '' and clean + toxic >= 3").withColumn("odd", odd).where("odd > 6.6").orderBy(F.desc("odd"), "f").limit(features).select("f", strong.alias("strong")).collect()
    chosen_features = [r["f"] for r in best]
    index = {f: i for i, f in enumerate(chosen_features)}
    if not index:
        return None
    shared = spark.sparkContext.broadcast(index)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = Extractor(shared.value)
        for batch in batches:
            found = [get.counts(t) for t in texts(batch, "__text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n in found], pa.int64()), pa.array([list(c.keys()) for c, _ in found], pa.list_(pa.int32())), pa.array([list(c.values()) for c, _ in found], pa.list_(pa.int32()))], names=["y", "words", "at", "n"])

    rows_ = sample.mapInArrow(vectors, "y int, words long, at array<int>, n array<int>").toPandas()
    size = [len(x) for x in rows_["at"]]
    row = np.repeat(np.arange(len(rows_)), size)
    cols = np.concatenate([np.asarray(x, np.int64) for x in rows_["at"]]) if sum(size) else np.empty(0, np.int64)
    raw = np.concatenate([np.asarray(x, np.float64) for x in rows_["n"]]) if sum(size) else np.empty(0)
    y = rows_["y"].to_numpy()
    is_strong = np.array([r["strong"] for r in best], float)
    density = np.bincount(row, raw * is_strong[cols], len(rows_)) / np.maximum(1, rows_["words"].to_numpy())
    cuts = np.unique(np.quantile(density[y == 1], [k / bands for k in range(1, bands)])) if bands > 1 else np.empty(0)
    grades = np.where(y == 1, 1 + np.searchsorted(cuts, density, side="left"), 0)
    used = np.unique(grades)
    grades = np.searchsorted(used, grades)  # no grade without rows
    weights, thresholds = _fit((row, cols, np.log1p(raw)), len(rows_), len(index), grades, len(used) - 1, l2, steps)
    return Model(index, weights, thresholds)


def score(df: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: float = 0.5) -> DataFrame:
    """``keep``, expected_severity (0 to K), p_toxic (probability of any grade above 0) and toxic (p_toxic > limit) of each row.

    Null and empty texts have no features: they get the model's base rates.
    Without a model (no labelled rows of both kinds) all are 0 and not toxic.
    """
    sc = df.sparkSession.sparkContext
    shared, key = sc.broadcast(model), f"toxicity-{sc.applicationId}-{next(_numbers)}"
    schema = T.StructType([df.schema[k] for k in keep]).add("expected_severity", "double").add("p_toxic", "double").add("toxic", "boolean")

    def make(batch: pa.RecordBatch) -> dict:
        out = {k: batch.column(i) for i, k in enumerate(keep)}
        model = shared.value
        if model is None:
            zero = np.zeros(batch.num_rows)
            return out | {"expected_severity": zero, "p_toxic": zero, "toxic": zero > 0}
        get, w = remembered(key, lambda: Extractor(model.features)), model.weights
        margin = np.array([sum(w[i] * math.log1p(n) for i, n in sorted(get.counts(t)[0].items())) for t in texts(batch, "__text")])
        above = model.above(margin)
        return out | {"expected_severity": above.sum(axis=1), "p_toxic": above[:, 0], "toxic": above[:, 0] > limit}

    return arrow_map(df.select(*keep, text_column(df, text).alias("__text")), make, schema)
