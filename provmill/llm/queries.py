"""The registered queries of this subpackage and their SQL twins.

A query applies one operator, with its production parameters, to the whole of
the table it is meant for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provmill.llm import alignment, digests, histogram_packing, html_text, language, lattice_lm, merkle, packing, simhash, toxicity, warc
from provmill.llm.common import crc_mod, table, written
from provmill.llm.decontaminate import contamination
from provmill.llm.token_counts import token_counts


def tokenizer(name: str) -> str:
    """Path of a public tokenizer file; its package is on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected toxicity grade of all documents; learned from a sample of the labelled ones."""
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.train(documents, table(spark, sf_dir, "labels")))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical digests of all documents, of their edits and of their neighbours.

    Exact digests are alike (1) or not (0).
    """
    documents = table(spark, sf_dir, "documents")
    rows = written(digests.edited_texts(documents), "edited")
    collisions = written(digests.colliding(documents, rows.select("fingerprint")), "colliding")
    for fingerprint, wide in (("fingerprint", "wide"), ("edited_fingerprint", "edited_wide"), ("next_fingerprint", "next_wide")):
        rows = digests.resolve(rows, collisions, fingerprint, wide)
    same = lambda other: (F.col("fingerprint") == F.col(other)).cast("double")
    rows = written(rows, "resolved")
    groups = written(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("group_size")), "groups")  # with plain exchanges on both sides of the join a large group can be split
    return rows.join(groups, "fingerprint").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", same("edited_fingerprint").alias("near_edited"), same("next_fingerprint").alias("near_next"), "group_id", "group_size"
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens in sequences of at most 4096."""
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of ten words found in all documents."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), F.col("component").alias("component_id"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents; learned from those whose remainder isn't 1."""
    documents = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)))
    model = language.train(documents.where("not held_out"))
    return language.predict(documents, model, keep=("doc_id", "held_out"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents for the byte-level vocabulary."""
    return token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op9_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents; learned from those whose remainder isn't 0."""
    documents = table(spark, sf_dir, "documents").withColumn("held_out", crc_mod("doc_id", 10) == 0)
    return lattice_lm.scores(documents, tokenizer("piece_bpe_32k.model"), kind="lang")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op11_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens in sequences of 4096, or a power of two, without padding."""
    return histogram_packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between the tokens of two vocabularies in all documents, and how common each is in the corpus."""
    return alignment.aligned(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's proof in a manifest of all, checked against a copy without line ends where the id's remainder is 0."""
    documents = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.when(crc_mod("doc_id", 2) == 0, merkle.leaf(*fields, F.replace("text", F.lit("\n"), F.lit(""))))
    leaves = written(documents.select("doc_id", "source", merkle.leaf(*fields, F.col("text")).alias("leaf"), tampered.alias("claimed")), "digests")
    return merkle.verified(merkle.manifest(leaves))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_fingerprints": op2_fingerprints,
    "op3_packing": op3_packing,
    "op4_decontaminate": op4_decontaminate,
    "op5_simhash": op5_simhash,
    "op6_html_text": op6_html_text,
    "op7_language": op7_language,
    "op8_token_counts": op8_token_counts,
    "op9_lattice_lm": op9_lattice_lm,
    "op10_warc": op10_warc,
    "op11_window_packing": op11_window_packing,
    "op12_alignment": op12_alignment,
    "op13_merkle": op13_merkle,
}

_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_FIELD = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda a, c: list_reduce(list_prepend(xor(a, c), CAST(range(8) AS BIGINT[])), lambda r, k: xor(r >> 1, 3988292384 * (r & 1)))))"""

ORACLE_SQL: dict[str, str] = {
    "op4_decontaminate": f"""
    WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format("text")} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
    cut AS (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM items WHERE len(w) > 0),
    windows AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS body FROM cut),
    docs AS (SELECT doc_id, coalesce({_WORDS.format("text")}, CAST([] AS VARCHAR[])) AS w FROM documents),
    places AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
    spots AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS body FROM places),
    found AS (SELECT doc_id, spots.n, i, item FROM spots JOIN windows ON windows.n = spots.n AND windows.body = spots.body),
    words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id),
    named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS all_items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(all_items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op10_warc": """
    WITH p AS (SELECT page_id, coalesce(html, '') AS h, unhex(sha1(coalesce(html, ''))) AS d FROM pages),
    g AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
    SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
      array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda b: get_bit(CAST(d AS BIT), CAST(5 * k + b AS INTEGER)) << CAST(4 - b AS INTEGER)))::INTEGER, 1)), '') AS payload_digest,
      CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
    FROM p JOIN g USING (h)""",
    "op13_merkle": f"""
    WITH RECURSIVE leaves AS (SELECT doc_id, source, {_LEAF.format("text")} AS leaf, CASE WHEN {_CRC} % 2 = 0 THEN {_LEAF.format("replace(text, chr(10), '')")} END AS claimed FROM documents),
    placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM leaves),
    tree AS (SELECT source, 0 AS level, i, n, leaf AS h FROM placed
      UNION ALL SELECT source, level + 1, i // 3, (max(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY source, level, i // 3),
    subroots AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS g, count(*) OVER () AS n FROM tree WHERE n = 1),
    top AS (SELECT 0 AS level, g AS i, n, subroot AS h FROM subroots
      UNION ALL SELECT level + 1, i // 3, (max(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, i // 3),
    runs AS (SELECT source, level, i // 3 AS up, list(h ORDER BY i) AS hs FROM tree WHERE n > 1 GROUP BY source, level, i // 3),
    top_runs AS (SELECT level, i // 3 AS up, list(h ORDER BY i) AS hs FROM top WHERE n > 1 GROUP BY level, i // 3),
    climb AS (SELECT row_number() OVER () AS rid, source, i AS spot, 0 AS level, coalesce(claimed, leaf) AS h, '' AS siblings FROM placed
      UNION ALL SELECT rid, c.source, spot // 3, c.level + 1, sha256(array_to_string(list_concat(hs[:spot % 3], [h], hs[spot % 3 + 2:]), '')), siblings || array_to_string(list_concat(hs[:spot % 3], hs[spot % 3 + 2:]), '')
      FROM climb c JOIN runs r ON r.source IS NOT DISTINCT FROM c.source AND r.level = c.level AND r.up = spot // 3),
    climbed AS (SELECT rid, source, arg_max(h, level) AS h, arg_max(siblings, level) AS siblings FROM climb GROUP BY rid, source),
    crown AS (SELECT rid, c.source, g AS spot, 0 AS level, h, siblings FROM climbed c JOIN subroots s ON s.source IS NOT DISTINCT FROM c.source
      UNION ALL SELECT rid, source, spot // 3, c.level + 1, sha256(array_to_string(list_concat(hs[:spot % 3], [h], hs[spot % 3 + 2:]), '')), siblings || array_to_string(list_concat(hs[:spot % 3], hs[spot % 3 + 2:]), '')
      FROM crown c JOIN top_runs r ON r.level = c.level AND r.up = spot // 3),
    crowned AS (SELECT rid, arg_max(h, level) AS folded_root, arg_max(siblings, level) AS siblings FROM crown GROUP BY rid),
    named AS (SELECT row_number() OVER () AS rid, doc_id, source, leaf FROM placed)
    SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, folded_root, folded_root = root AS verified
    FROM crowned JOIN named USING (rid) JOIN subroots s ON s.source IS NOT DISTINCT FROM named.source, (SELECT h AS root FROM top WHERE n = 1)""",
}
