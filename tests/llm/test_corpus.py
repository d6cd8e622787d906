"""The registered queries on the smallest tables, against brute force or held-out labels."""

import re
from html import unescape

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from provmill.llm import simhash
from provmill.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return {r[0]: r for r in duckdb.sql(f"select doc_id, text, lang from read_parquet('{DATA}/documents.parquet')").fetchall()}


def rows(spark, name):
    return QUERIES[name](spark, DATA).collect()


def test_names():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14)) and set(ORACLE_SQL) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "simhash_dedup", "decontamination", "packing"]


def test_toxicity(spark):
    toxic = dict(duckdb.sql(f"select doc_id, toxic from read_parquet('{DATA}/labels.parquet')").fetchall())
    got = {r.doc_id: r.toxic for r in rows(spark, "op1_toxicity")}
    right = [got[d] == bool(t) for d, t in toxic.items() if d in got]
    assert np.mean(right) > 0.95


def test_near_duplicates(spark, docs):
    got = {r.doc_id: r for r in rows(spark, "op5_simhash")}
    fps = {d: simhash.majority(simhash.shingle_hashes(r[1] or "")) for d, r in docs.items()}
    ids = sorted(docs)
    least = {d: d for d in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if least[a] < least[b] and (fps[a] ^ fps[b]).bit_count() <= 4:
                    least[b], changed = least[a], True
    assert {d: (r.fingerprint, r.component_id) for d, r in got.items()} == {d: (f"{fps[d]:016x}", least[d]) for d in ids}


def test_shingles_as_defined():
    import xxhash

    text = "A b\tC  d\x0be F\x85g É"
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)}))
    want = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(len(words) - 3)]
    assert simhash.shingle_hashes(text).tolist() == want
    assert simhash.majority(np.array([1, 3, 2], np.uint64)) == 3 and simhash.majority(np.array([1, 2], np.uint64)) == 0


def test_pages(spark):
    html = dict(duckdb.sql(f"select page_id, html from read_parquet('{DATA}/pages.parquet')").fetchall())
    for r in rows(spark, "op6_html_text"):
        inside = re.search(r"<article>(.*)</article>", html[r.page_id], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inside))]
        assert r.text == "\n".join(b for b in blocks if b)


def test_language(spark, docs):
    held = [r for r in rows(spark, "op7_language") if r.held_out]
    assert len(held) > 30 and np.mean([r.lang_pred == docs[r.doc_id][2] for r in held]) > 0.93


def test_edits_and_likeness(spark, docs):
    import hashlib

    from provmill.llm.digests import canonical, digest

    order = sorted(docs, reverse=True)
    got = {r.doc_id: r for r in rows(spark, "op2_fingerprints")}
    for i, d in enumerate(order):
        text, after = docs[d][1] or "", docs[order[(i + 1) % len(order)]][1] or ""
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        r = got[d]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), digest(canonical(text)), digest(canonical(edited)))
        assert (r.near_edited, r.near_next) == (float(canonical(text) == canonical(edited)), float(canonical(text) == canonical(after)))
        assert r.group_size == sum(canonical(x[1] or "") == canonical(text) for x in docs.values())


def test_packing_has_the_ids_of_the_library(spark, docs):
    import zlib

    from tokenizers import Tokenizer

    from provmill.llm.queries import tokenizer

    library, want = Tokenizer.from_file(tokenizer("word_bpe_49k.json")), set()
    for d, r in docs.items():
        ids = np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        want |= {(d, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())) for k in range(0, len(ids), 4096)}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows(spark, "op3_packing")} == want


def test_token_counts(spark, docs):
    from tokenizers import Tokenizer

    from provmill.llm.queries import tokenizer

    library = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    assert {(r.doc_id, r.n_bytes, r.n_tokens) for r in rows(spark, "op8_token_counts")} == {(d, len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for d, r in docs.items()}


def test_window_packing(spark, docs):
    from test_window_packing import sound

    sound(rows(spark, "op11_window_packing"), {d: r[1] for d, r in docs.items()}, 4096)


def test_alignment(spark, docs):
    from test_alignment import Plain

    ids = sorted(docs)
    want = zip(ids, Plain().rows([docs[d][1] for d in ids]), strict=True)
    assert sorted(map(tuple, rows(spark, "op12_alignment"))) == [(d, *r) for d, r in want]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    got = QUERIES[name](spark, DATA)
    columns = ", ".join(got.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(con.sql(f"select {columns} from ({ORACLE_SQL[name]})").fetchall(), key=repr)


@pytest.mark.parametrize("name", ["op9_lattice_lm"])
def test_every_document_is_there(spark, docs, name):
    assert {r.doc_id for r in rows(spark, name)} == set(docs)


def least_of_classes(docs, words, similarity):
    """The least ids of the classes that all pairs of documents of this similarity make, by brute force."""
    by_set = {}
    for d in sorted(docs):
        parts = re.sub(r"[A-Z]", lambda m: m[0].lower(), docs[d] or "").encode().split()
        by_set.setdefault(frozenset(tuple(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))), []).append(d)
    sets, root = list(by_set), list(range(len(by_set)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if min(len(a), len(b)) >= similarity * max(len(a), len(b)) and len(a & b) >= similarity * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, s in enumerate(sets):
        least.setdefault(find(i), []).extend(by_set[s])
    return {min(ids) for ids in least.values()}


def test_pipeline_against_its_parts(spark, docs):
    """Each stage drops just what its operator's own query names, judged on the stage's input."""
    from provmill.llm.common import table, written

    before = table(spark, DATA, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, before, DATA), "stage")
        kept, had = {r.doc_id for r in after.select("doc_id").collect()}, {r.doc_id for r in before.select("doc_id").collect()}
        assert kept <= had and after.columns == before.columns and after.count() == len(kept)
        if name == "language_id":
            assert len(kept) > 0.98 * len(had)
        if name == "simhash_dedup":
            assert kept == least_of_classes({r.doc_id: r.text for r in before.select("doc_id", "text").collect()}, corpus_pipeline.SHINGLE_WORDS, corpus_pipeline.LEAST_SIMILARITY)
        before = after
    packed = corpus_pipeline.pack(spark, before, DATA).collect()
    assert {r.doc_id for r in packed} == kept
    whole = {r.doc_id for r in corpus_pipeline.run(spark, DATA).collect()}
    assert whole == kept
