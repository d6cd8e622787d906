"""Packing by least squares: every token once, no gap, no padding, and full windows wherever lengths allow."""

import zlib
from collections import Counter

import numpy as np
import pytest

from provmill.llm import histogram_packing
from provmill.llm.queries import tokenizer

PATH = tokenizer("word_bpe_49k.json")


def sound(rows, texts, capacity, end_id=2):
    """``texts`` by id; each id once."""
    from tokenizers import Tokenizer

    library, by, bins = Tokenizer.from_file(PATH), {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert by.keys() == texts.keys()
    for d, t in texts.items():
        ids, at = np.array([*library.encode(t or "", add_special_tokens=False).ids, end_id], "<u4"), 0
        for r in sorted(by[d], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    sizes = []
    for used in bins.values():
        at = 0
        for offset, length in sorted(used):
            assert offset == at
            at += length
        sizes.append(at)
    assert all(n == capacity or n & n - 1 == 0 and n < capacity for n in sizes)
    assert len(sizes) <= sum(sizes) // capacity + capacity.bit_length()
    assert max(Counter(n for n in sizes if n < capacity).values(), default=1) == 1


def test_odd_rows(spark):
    """Nulls, empty and very long texts, ties, clashing columns; ids of any type."""
    texts = {"a": None, "b": "", "c": "word " * 10_000, "d": "it's 100% Ünïcode ﬁne 日本", "e": "<|endoftext|> x", **{f"t{i}": "same length" for i in range(300)}, **{f"u{i}": "tok " * i for i in range(200)}}
    df = spark.createDataFrame([(d, t, 1, 2, "part") for d, t in texts.items()], "doc_id string, text string, length int, start int, part string").repartition(3)
    for capacity in (64, 4096):
        got = histogram_packing.pack(df, PATH, capacity=capacity)
        assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        sound(got.collect(), texts, capacity)
    assert histogram_packing.pack(df.limit(0), PATH).collect() == []
    repeated = histogram_packing.pack(df.where("doc_id = 'u9'").unionAll(df.where("doc_id = 'u9'")).withColumn("doc_id", df.doc_id.substr(9, 1)), PATH).collect()
    assert sum(r.length for r in repeated) == 20 and {r.doc_tokens for r in repeated} == {10}


@pytest.mark.parametrize("counts", [{}, {5: 1}, {64: 3}, {3: 7, 61: 4, 64: 1}, {1: 1000}, {33: 500}, {16: 40, 24: 20, 63: 9, 1: 3}])
def test_plans_use_what_there_is(counts):
    have = np.zeros(65, np.int64)
    for n, many in counts.items():
        have[n] = many
    bins, left = histogram_packing.plan(have)
    used = Counter()
    for times, inside in bins:
        assert sum(n * k for n, k in inside) == 64 and times > 0
        for n, k in inside:
            used[n] += times * k
    assert {n: used[n] + int(left[n]) for n in {*used, *np.flatnonzero(left).tolist()}} == counts
    places = histogram_packing.Places(have)
    spans = Counter()
    for n, many in counts.items():
        for own in places.place(np.full(many, n), np.arange(many)):
            assert [s for s, *_ in own] == np.cumsum([0, *(k for _, k, *_ in own)])[:-1].tolist() and sum(k for _, k, *_ in own) == n
            for _, k, w, o in own:
                spans[w] += k
                assert o + k <= 64
    assert sum(spans.values()) == sum(n * many for n, many in counts.items())


def test_least_squares_finds_the_counts_that_made_a_histogram():
    """Against the normal equations' conditions: no combination can gain, none is negative."""
    have = np.zeros(65, np.int64)
    for n, many in {40: 300, 24: 300, 10: 90, 54: 90, 32: 200, 8: 33}.items():
        have[n] = many
    columns = histogram_packing.combinations(have)
    uses = histogram_packing.least_squares(columns, have)
    rest = have.astype(float)
    for (a, m, b, n), x in zip(columns, uses, strict=True):
        rest[a] -= m * x
        rest[b] -= n * x
    slope = columns[:, 1] * rest[columns[:, 0]] + columns[:, 3] * rest[columns[:, 2]]
    assert (uses >= 0).all() and slope.max() < 0.05 * have.sum() and abs(slope[uses > 1]).max() < 0.05 * have.sum() and np.linalg.norm(rest) < 0.05 * np.linalg.norm(have)
