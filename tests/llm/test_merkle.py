"""The Merkle manifest against a brute-force tree, on odd rows and at every height of a page."""

import hashlib

import pytest
from pyspark.sql import functions as F

from provmill.llm import merkle

SCHEMA = "doc_id long, source string, lang string, text string, steps int, hash string, page int"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def encoded(*values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def grow(nodes):
    """The root, and of each node the (siblings before, siblings after) up to it."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, at, strict=True):
            run = nodes[i - i % 3 : i - i % 3 + 3]
            path.append((run[: i % 3], run[i % 3 + 1 :]))
        nodes, at = [sha("".join(nodes[k : k + 3])) for k in range(0, len(nodes), 3)], [i // 3 for i in at]
    return nodes[0], paths


def brute(rows):
    """rows: (doc_id, source, leaf, claimed)."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    grown = {}
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        grown[s] = grow([r[2] for r in by[s]])
    root, tops = grow([grown[s][0] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        for r, path in zip(by[s], grown[s][1], strict=True):
            hash, siblings = r[3] or r[2], ""
            for before, after in path + top:
                hash, siblings = sha("".join([*before, hash, *after])), siblings + "".join(before + after)
            out.append((r[0], r[2], grown[s][0], root, sha(siblings), hash, hash == root))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(d, s, None, t, 1, "clash", 2) for d, s, t in rows], SCHEMA).repartition(3)
    fields = [F.col(c) for c in ("doc_id", "source", "lang")]
    leaves = df.withColumn("leaf", merkle.leaf(*fields, F.col("text"))).withColumn("claimed", F.when(F.col("doc_id") % 2 == 0, merkle.leaf(*fields, F.replace("text", F.lit("\n"), F.lit("")))))
    return sorted((tuple(r) for r in merkle.verified(merkle.manifest(leaves)).collect()), key=str)


def want(rows):
    return brute([(d, s, sha(encoded(d, s, None, t)), sha(encoded(d, s, None, t and t.replace("\n", ""))) if d is not None and d % 2 == 0 else None) for d, s, t in rows])


def test_odd_rows(spark):
    """Nulls, empty and very long texts, repeated rows and ids, sources of one row and of many, bytewise order of sources."""
    rows = [(1, "a", "x\ny"), (2, "a", "x\ny"), (2, "a", "other"), (2, "a", "x\ny"), (None, "a", None), (None, None, "n\n"), (4, None, ""), (6, "Z", "\n"), (8, "é", "日本\n" * 50_000), (9, "\U0001f600", "last"), (10, "￮", "not last")]
    assert run(spark, rows) == want(rows)


@pytest.mark.parametrize("many", [1, 3, 10, 28, 244, 731])
def test_heights(spark, many):
    rows = [(i, "hot", f"text {i}\n") for i in range(many)] + ([(i, f"s{i}", "few") for i in range(40)] if many > 100 else [])
    assert run(spark, rows) == want(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_one_document_has_no_siblings(spark):
    leaf = sha(encoded(7, "s", None, "t"))
    assert run(spark, [(7, "s", "t")]) == [(7, leaf, leaf, leaf, sha(""), leaf, True)]
