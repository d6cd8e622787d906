"""Near-duplicate classes at a stated similarity: several SimHash fingerprints, ball hashing, an exact check.

One 64-bit fingerprint can't reach a Jaccard similarity of 0.8, where about 15 %
of the bits differ.  So a text has ``BANDS`` independent fingerprints of 32 bits
each over the set of its shingles, and texts are candidates if in any band they
differ in at most 2 bits: every fingerprint emits all strings within 1 bit of it,
and fingerprints that meet in a string are paired.  As in ``simhash``, strings
are dealt to cells by their first bits and made there.

All bands together estimate the similarity of a candidate; those that may reach
the threshold are compared by their whole shingle sets, first the likeliest of
each text, then those between classes that are still apart.  So no text goes
that isn't linked to one that stays by pairs that reach the threshold; how many
of such pairs are found is a matter of the bands (measured in the README).

Texts of equal words are one node.  Nodes with an equal fingerprint are compared
to the least of them only, so a group of copies makes no more pairs than it has
members in each band.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provmill.llm.common import arrow_map, cut, text_column, texts
from provmill.llm.components import components
from provmill.llm.simhash import ball, folded, meetings, shingle_hashes

#: Fingerprints of a text and the bits of each; two of them make one 64-bit word of the sketch.
BANDS, WIDTH = 24, 32
WORDS = BANDS * WIDTH // 64
#: Candidates have so many differing bits in a band at most: twice the radius of a ball.
RADIUS = 1
#: Strings of a cell on average at most, first bits that name a cell at least and at most: memory, not results, depends on them.
CELL_STRINGS, LEAST_BITS, MOST_BITS = 2_000_000, 2, 20
#: Fingerprints of more than two nodes are broadcast up to so many (of 24 bytes), joined by a shuffle beyond.
BROADCAST_ROWS = 200_000
#: A candidate is compared if its bits differ by so many standard deviations more than expected at the threshold, at most.
DEVIATIONS = 4

#: One odd constant for each word of the sketch (from a rule: multiples of the golden ratio's fraction).
_SALTS = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str, words: int) -> np.ndarray:
    """The distinct XXH64 of a text's shingles, in order."""
    return np.unique(shingle_hashes(text, words))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """``WORDS`` 64-bit words: each bit is 1 if set in over half of the mixed hashes."""
    if not len(hashes):
        return np.zeros(WORDS, np.uint64)
    counts = np.zeros(64 * WORDS, np.int64)
    for i in range(0, len(hashes), 255):
        x = hashes[i : i + 255, None] + _SALTS[None, :]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        counts += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes)).view(np.uint64)


def sketches(df: DataFrame, text: str, keep: tuple[str, ...], words: int) -> DataFrame:
    """``keep``, same (digest of the text's words) and s0, s1, ...: the sketch."""
    schema = T.StructType([df.schema[k] for k in keep]).add("same", "binary")
    for i in range(WORDS):
        schema = schema.add(f"s{i}", "long")

    def make(batch: pa.RecordBatch) -> dict:
        same, rows = [], np.zeros((batch.num_rows, WORDS), np.uint64)
        for i, t in enumerate(texts(batch, "__text")):
            same.append(xxhash.xxh3_128_digest(b" ".join(folded(t))))
            rows[i] = sketch(shingle_set(t, words))
        whole = np.ascontiguousarray(rows.T).view(np.int64)
        return {k: batch.column(i) for i, k in enumerate(keep)} | {"same": same} | {f"s{i}": whole[i] for i in range(WORDS)}

    return arrow_map(df.select(*keep, text_column(df, text).alias("__text")), make, schema)


def sets(df: DataFrame, text: str, keep: tuple[str, ...], words: int) -> DataFrame:
    """``keep`` and shingles, the hashes of the text's distinct shingles."""
    schema = T.StructType([df.schema[k] for k in keep]).add("shingles", T.ArrayType(T.LongType(), False))

    def make(batch: pa.RecordBatch) -> dict:
        found = [shingle_set(t, words).view(np.int64) for t in texts(batch, "__text")]
        ends = np.cumsum([0, *(len(x) for x in found)])
        flat = pa.array(np.concatenate(found))
        return {k: batch.column(i) for i, k in enumerate(keep)} | {"shingles": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)}

    return arrow_map(df.select(*keep, F.col(text).alias("__text")), make, schema)


def candidates(nodes: DataFrame) -> DataFrame:
    """(u, v), u < v: nodes with fingerprints that meet in a string, for the least node of each fingerprint, and all others with that."""
    mask = (1 << WIDTH) - 1
    bands = F.array(*(F.struct(F.lit(2 * i + half).alias("band"), F.shiftrightunsigned(f"s{i}", WIDTH * half).bitwiseAND(F.lit(mask)).alias("fp")) for i in range(WORDS) for half in range(2)))
    each = nodes.select("node", F.explode(bands).alias("b")).select("node", "b.band", "b.fp")
    heads = cut(each.groupBy("band", "fp").agg(F.min("node").alias("head"), F.max("node").alias("last"), F.count("*").alias("n")))
    n, strings = heads.count(), sum(len(x) for x in ball(range(WIDTH), RADIUS).values())
    bits = LEAST_BITS
    while bits < MOST_BITS and n * strings > (BANDS * CELL_STRINGS) << bits:
        bits += 1
    flips = F.explode(F.array(*(F.lit(int(m)).cast("long") for x in ball(range(bits), RADIUS).values() for m in x)))
    dealt = heads.select("band", "fp", "head", flips.alias("flip"))
    dealt = dealt.select((F.col("band") * (1 << bits) + F.shiftright("fp", WIDTH - bits).bitwiseXOR(F.col("flip")).cast("int")).alias("cell"), "fp", "head")

    def search(batches):
        """Rows come sorted by cell."""

        def rows():
            for batch in batches:
                cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
                cuts = [0, *(np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1).tolist(), len(cols[0])]
                for x, y in zip(cuts, cuts[1:], strict=False):
                    if y > x:
                        yield int(cols[0][x]), cols[1][x:y], cols[2][x:y]

        for cell, run in groupby(rows(), key=lambda r: r[0]):
            held = list(run)
            fp = np.concatenate([r[1] for r in held]).view(np.uint64)
            head = np.concatenate([r[2] for r in held])
            del held
            order = np.argsort(fp)  # each fingerprint comes once
            fp, head = fp[order], head[order]
            first = np.uint64(cell & ((1 << bits) - 1))
            far = np.bitwise_count((fp >> np.uint64(WIDTH - bits)) ^ first).astype(np.int32)
            parts = -(-len(fp) * strings // CELL_STRINGS)
            for part in range(parts):
                a, b = meetings(fp, far, bits, RADIUS, part, parts, WIDTH)
                if len(a):
                    a, b = head[a], head[b]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["u", "v"])

    met = dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(search, "u long, v long")
    two = heads.where("n = 2").select(F.col("head").alias("u"), F.col("last").alias("v"))
    more = heads.where("n > 2").select("band", "fp", "head")
    if more.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        more = F.broadcast(more)
    like = each.join(more, ["band", "fp"]).select(F.col("head").alias("u"), F.col("node").alias("v"))
    return met.unionAll(two).unionAll(like).where("u < v").distinct()


def most_bits(similarity: float) -> float:
    """Bits of the sketches of a candidate that differ at most: those expected for sets of equal size, and the deviations."""
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return BANDS * WIDTH * (share + DEVIATIONS * (share * (1 - share) / (BANDS * WIDTH)) ** 0.5)


def similar(shingles: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) with a Jaccard similarity of ``similarity`` or more, by their whole sets."""
    a = shingles.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    b = shingles.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    both = pairs.select("u", "v").join(a, "u").join(b, "v")
    common = F.size(F.array_intersect("a", "b"))
    return both.withColumn("n", common).where(F.col("n") >= similarity * (F.size("a") + F.size("b") - F.col("n"))).where("n > 0").select("u", "v")


def representatives(df: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``df`` that stay when one row of each class of near-duplicates is kept: the one with the least id.

    Classes are connected by pairs of texts whose sets of ``words``-word shingles
    (A-Z in lower case, ASCII blanks between words; fewer words: the whole
    sequence) have a Jaccard similarity of ``similarity`` or more.  Texts of
    equal words are alike, so null, empty and wordless texts are one class.

    Null ids come last; of rows with equal ids the one with the least digest of
    its words stays, then the one with the least digest of its text.  Of rows
    with the same id and text any one stays.  Columns of any name are kept.  An empty table gives an empty result.
    """
    names = df.columns
    plain = [f"__column{i}" for i in range(len(names))]  # can't clash with the names used here
    df, id, text = df.toDF(*plain), plain[names.index(id)], plain[names.index(text)]
    digest = F.unhex(F.md5(text_column(df, text).cast("binary")))  # id and text name a row's class; the id alone doesn't
    named = df.withColumn("__digest", digest)
    each = cut(sketches(named, text, (id, "__digest"), words))
    parts = [f"s{i}" for i in range(WORDS)]
    first = F.min(F.struct(F.col(id).isNull().alias("none"), F.col(id).alias("id"), F.col("same"), F.col("__digest").alias("digest")))
    nodes = each.groupBy("same").agg(first.alias("head"), *(F.first(s).alias(s) for s in parts))
    # numbered in the order of their digests, so that which of them is the least doesn't depend on how rows came
    nodes = cut(nodes.orderBy("same").withColumn("node", F.monotonically_increasing_id()).drop("same"))
    repeated = each.groupBy(id, "__digest").count().where("count > 1").limit(1).count()

    def rows_of(heads: DataFrame, *columns: str) -> DataFrame:
        """One row of ``named`` for each of ``heads``."""
        at = heads.select(F.col("head.id").alias("__id"), F.col("head.digest").alias("__kept"), *columns)
        rows = named.join(at, F.col(id).eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__kept"))).drop("__id", "__kept")
        return rows.dropDuplicates([id, "__digest"]) if repeated else rows

    left, right = ([F.col(s).alias(f"{side}{s}") for s in parts] for side in "ab")
    pairs = candidates(nodes).join(nodes.select(F.col("node").alias("u"), *left), "u").join(nodes.select(F.col("node").alias("v"), *right), "v")
    bits = sum((F.bit_count(F.col(f"a{s}").bitwiseXOR(F.col(f"b{s}"))) for s in parts), F.lit(0))
    pairs = cut(pairs.select("u", "v", bits.alias("bits")).where(F.col("bits") <= most_bits(similarity)))
    met = pairs.select(F.col("u").alias("node")).unionAll(pairs.select("v")).distinct()
    asked = rows_of(nodes.select("head", F.col("node").alias("__node")).join(met.withColumnRenamed("node", "__node"), "__node"), "__node")
    whole = cut(sets(asked.select(F.col("__node").alias("node"), text_column(asked, text).alias("__whole")), "__whole", ("node",), words))
    likeliest = pairs.groupBy("v").agg(F.min_by("u", F.struct("bits", "u")).alias("u"))
    sure = cut(similar(whole, likeliest, similarity))
    found = components(sure)
    apart = pairs.join(likeliest, ["u", "v"], "left_anti").join(found.select(F.col("node").alias("u"), F.col("root").alias("p")), "u", "left").join(found.select(F.col("node").alias("v"), F.col("root").alias("q")), "v", "left")
    apart = apart.where(F.coalesce("p", "u") != F.coalesce("q", "v"))
    found = components(sure.unionAll(similar(whole, apart, similarity)))
    classes = nodes.select("node", "head").join(found, "node", "left").groupBy(F.coalesce("root", "node").alias("class")).agg(F.min("head").alias("head"))
    return rows_of(cut(classes)).select(*plain).toDF(*names)
