"""A corpus from raw documents to packed sequences, stage by stage.

Each stage gets what its predecessor kept, written as Parquet and read again,
and returns the columns of documents; the last returns the placement of tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provmill.llm import language, packing, similar, toxicity
from provmill.llm.common import crc_mod, table, written
from provmill.llm.decontaminate import contamination
from provmill.llm.queries import tokenizer

#: A document goes if its words aren't likelier of one language than of all others together.
LEAST_CONFIDENCE = 0.5
#: A document goes if it is toxic with at least this probability.
MOST_TOXIC = 0.5

#: Texts are alike if their sets of shingles of so many words have this Jaccard similarity.
SHINGLE_WORDS, LEAST_SIMILARITY = 5, 0.8


def _judged(docs: DataFrame, judge: Callable[..., DataFrame], keep_if: str) -> DataFrame:
    """The rows of ``docs`` that ``judge`` lets stay; its result columns can't clash with theirs."""
    names = docs.columns
    plain = [f"__column{i}" for i in range(len(names))]
    judged = judge(docs.toDF(*plain), text=plain[names.index("text")], keep=tuple(plain))
    return judged.where(keep_if).select(*plain).toDF(*names)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no certain language, go.

    Learned from the documents whose remainder isn't 1, as in the query.
    """
    model = language.train(docs.where(F.coalesce(crc_mod("doc_id", 3) != 1, F.lit(True))))
    return _judged(docs, lambda d, **how: language.predict(d, model, **how), f"lang_pred <> '{language.UNKNOWN}' and confidence >= {LEAST_CONFIDENCE}")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are probably of a grade above 0 go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _judged(docs, lambda d, **how: toxicity.score(d, model, limit=MOST_TOXIC, **how), "not toxic")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least id stays."""
    return similar.representatives(docs, words=SHINGLE_WORDS, similarity=LEAST_SIMILARITY)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which ten consecutive words of a benchmark item occur go."""
    return _judged(docs, lambda d, **how: contamination(d, table(spark, sf_dir, "benchmark"), **how), "not contaminated")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All tokens in sequences of at most 4096."""
    return packing.pack(packing.pieces(docs, tokenizer("word_bpe_49k.json")))


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: No stage but the first could be written in SQL: fits, fingerprints and tokenizers aren't expressible.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
