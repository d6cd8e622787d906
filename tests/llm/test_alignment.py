"""Cross-tokenizer alignment against the libraries, text by text and over a table."""

import hashlib
import random
from collections import Counter

import pytest

from provmill.llm import alignment
from provmill.llm.queries import tokenizer
from provmill.llm.token_counts import byte_symbols

FIRST, SECOND = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")


class Plain:
    """Both libraries on whole texts, and everything counted pair by pair."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(FIRST), sentencepiece.SentencePieceProcessor(model_file=SECOND)
        self.a.encode_special_tokens = True
        self.back = {s: b for b, s in byte_symbols().items()}

    def tokens(self, text):
        """[(id, end)] of both, or nothing."""
        if not text:
            return [], []
        whole, out = (" " + text).encode(), []
        a = [(i, bytes(self.back[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()) for i in self.b.encode(text)]
        for side in (a, b):
            if b"".join(x for _, x in side) != whole:
                return [], []
            end, ends = 0, []
            for i, x in side:
                end += len(x)
                ends.append((i, end))
            out.append(ends)
        return out

    def rows(self, texts):
        links, out, most = [], [], Counter()
        for t in texts:
            a, b = self.tokens(t)
            both = sorted({e for _, e in a} & {e for _, e in b})
            links.append([(i, j) for i, e in a for j in [j for j, f in b if f == e]])
            groups = [",".join(str(i) for i, e in a if lo < e <= hi) + "|" + ",".join(str(j) for j, e in b if lo < e <= hi) for lo, hi in zip([0, *both], both, strict=False)]
            out.append([len(a), len(b), len(groups), len(links[-1]), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""])
        counts = Counter(x for own in links for x in own)
        for (_, j), n in counts.items():
            most[j] = max(most[j], n)
        return [(*r[:4], sum(counts[x] == most[x[1]] for x in own), sum(counts[x] for x in own), r[4]) for r, own in zip(out, links, strict=True)]


@pytest.fixture(scope="module")
def plain():
    return Plain()


BITS = ["a", "the", " ", "  ", "\n", "'s", "'", "12", "é", "日本", "!", "ing", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "　", "\x1c", "\xa0", "don't", "\t", "\r", "\r\n", ";\r", "\x00", "\U0001f600", "ﬁ", " ", " Hello", "word", " ", "\x85", "ß"]


def test_units_give_the_tokens_of_whole_texts(plain):
    aligner, rng = alignment.Aligner(FIRST, SECOND), random.Random(11)
    for _ in range(3000):
        t = "".join(rng.choice(BITS) for _ in range(rng.randint(0, 30)))
        got = aligner.align(t)
        want = plain.rows([t])[0]
        assert (got[0], got[1], len(got[2]), got[3]) == (*want[:2], want[3], want[6]), repr(t)
    assert aligner.align("x ▁y")[:2] == (0, 0) and plain.rows(["x ▁y"])[0][6] == aligner.align("x ▁y")[3] == ""


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(alignment, "MOST_UNITS", 8)
    monkeypatch.setattr(alignment, "SLICE", 3)
    monkeypatch.setattr(alignment, "LONGEST_SLICE", 5)
    small, rng = alignment.Aligner(FIRST, SECOND), random.Random(3)
    monkeypatch.undo()
    large = alignment.Aligner(FIRST, SECOND)
    for _ in range(50):
        t = " ".join(rng.choice(["one", "two", "three" * 30, "four.", "five\nsix"]) for _ in range(12))
        a, b = small.align(t), large.align(t)
        assert a[:2] + a[3:] == b[:2] + b[3:] and a[2].tolist() == b[2].tolist()


@pytest.mark.parametrize("links", [40, 1_000_000])
def test_a_table(spark, plain, links):
    """Nulls, empty and long texts, repeated rows and ids, ties, clashing columns; small chunks give the same."""
    rng = random.Random(links)
    texts = [None, "", " ", "▁", "the cat", "the cat", "long word " * 3000, *("".join(rng.choice(BITS) for _ in range(20)) for _ in range(60))]
    ids = [*range(len(texts) - 2), 5, None]
    schema = "doc_id long, text string, chunk string, local int, stripe int, n_a string"
    df = spark.createDataFrame([(i, t, "c", 1, 2, "n") for i, t in zip(ids, texts, strict=True)], schema).repartition(3)
    got = alignment.aligned(df, FIRST, SECOND, chunk_links=links)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((i, *r) for i, r in zip(ids, plain.rows(texts), strict=True)), key=str)
    assert alignment.aligned(df.limit(0), FIRST, SECOND).collect() == []
