"""Token counts from a compiled finite-state transducer.

A byte-level BPE vocabulary is compiled, state by state as texts need them,
into a deterministic transducer over bytes.  A transition carries the number of
tokens that it adds to the count of the tokens so far (a byte that lets several
tokens merge adds a negative number), so the count of a pre-token is the sum
along its path.

Determinism rests on two facts about BPE with an ordered merge list: a token
sequence is the encoding of its bytes exactly if each pair of neighbours is the
encoding of the pair's bytes, and each prefix of a byte string has exactly one
encoding.  The last token of a prefix is therefore the one token that ends the
prefix and agrees with the last token of what precedes it.  What a state has to
know is bounded by the longest token: the longest suffix that may still grow
into a token, and for every position in it the last token and relative count.

A text is cut into chunks.  Wherever a white-space character follows another
character the transducer is in its start state whatever came before, so the
state map of a chunk has a closed form: what precedes the first such place, the
count between the first and the last, and what follows the last.  Maps compose
associatively and are combined by a parallel prefix scan.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provmill.llm.common import arrow_map, remembered, text_column, texts

#: Characters of the Unicode property White_Space (fixed values).
SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

#: States, memoised words and pairs kept by a worker before it starts afresh; no result depends on them.
MOST_STATES, MOST_WORDS, MOST_PAIRS = 250_000, 800_000, 400_000

#: Code points of a chunk.
CHUNK = 16_384


@lru_cache(4)
def _class_of(initial: str) -> str:
    """A character class of all code points whose general category starts with ``initial``."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == initial
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}" if c - 1 > start else f"\\U{start:08x}")
            start = None
    return "".join(out)


@lru_cache(1)
def pretokens() -> re.Pattern:
    """The pre-token rule of byte-level BPE vocabularies of this family."""
    letter, number = _class_of("L"), _class_of("N")
    return re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{letter}]+| ?[{number}]+| ?[^{SPACE}{letter}{number}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


#: A word with at most one space before it, or white space; each starts in the start state.
_UNIT = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
_ODD = re.compile(f"[^\\S \\n]|[ \\n][ \\n]|^[ \\n]| $|[\\x1c-\\x1f]")
_SYNC = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")


@lru_cache(1)
def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in such vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens and merge ranks over bytes."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {s: b for b, s in byte_symbols().items()}
        raw = lambda token: bytes(back[c] for c in token)
        self.id_of = {raw(token): i for token, i in spec["model"]["vocab"].items() if all(c in back for c in token)}
        self.bytes_of = {i: b for b, i in self.id_of.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.rank, self.made = {}, {}
        for r, (a, b) in enumerate(pairs):
            a, b = raw(a), raw(b)
            pair, whole = (self.id_of[a], self.id_of[b]), self.id_of[a + b]
            self.rank.setdefault(pair, (r, whole))
            self.made.setdefault(whole, (r, *pair))
        self.special = [x["content"] for x in spec["added_tokens"] if x["special"]]
        #: The trie of all tokens: node * 256 + byte -> node; the root is 0.  Of each node: its token, or None.
        self.child: dict[int, int] = {}
        self.token: list[int | None] = [None]
        for b, i in self.id_of.items():
            node = 0
            for byte in b:
                to = self.child.setdefault(node << 8 | byte, len(self.token))
                if to == len(self.token):
                    self.token.append(None)
                node = to
            self.token[node] = i
        self.pairs: dict[int, bool] = {}

    def agree(self, left: int, right: int) -> bool:
        """Whether the two tokens, side by side, are the encoding of their bytes.

        Undoing the merges that made the two, the latest first, shows every
        pair that stood at the border.  The border is crossed if such a pair
        has a merge of a lower rank than what came after it there.
        """
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._agree(left, right)
        return known

    def _agree(self, left: int, right: int) -> bool:
        made, rank = self.made, self.rank
        #: The border was as it is now until this (rank, side) merge; on equal ranks the left side is first.
        until = (len(rank), 0)
        while True:
            cross = rank.get((left, right))
            if cross is not None and (cross[0], 1) < until:
                return False
            a, b = made.get(left), made.get(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and a[0] > b[0]:
                until, left = (a[0], 0), a[2]
            else:
                until, right = (b[0], 2), b[1]


class Transducer:
    """Counts the tokens of pre-tokens; states come into being when first reached."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.reset()

    def reset(self) -> None:
        #: A state: for each place where the next token may have begun, the oldest first: the trie node of what follows it, the last token before it, the count there relative to now.
        self.states: list[tuple] = [(0, None, 0)]
        self.number = {self.states[0]: 0}
        self.moves: list[dict[int, tuple[int, int]]] = [{}]

    def step(self, state: int, byte: int) -> tuple[int, int]:
        child, tokens, places = self.v.child.get, self.v.token, self.states[state]
        token = count = None
        grown: list = []
        for i in range(0, len(places), 3):  # the longest candidate first
            node = child(places[i] << 8 | byte)
            if node is not None:
                before, n = places[i + 1], places[i + 2]
                grown += (node, before, n)
                if count is None and (t := tokens[node]) is not None and (before is None or self.v.agree(before, t)):
                    token, count = t, n + 1
        if count:
            for i in range(2, len(grown), 3):
                grown[i] -= count
        key = (*grown, 0, token, 0)
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        self.moves[state][byte] = to, count
        return to, count

    def count(self, data: bytes) -> int:
        if len(self.states) > MOST_STATES:
            self.reset()
        state = total = 0
        moves = self.moves
        for byte in data:
            state, emitted = moves[state].get(byte) or self.step(state, byte)
            total += emitted
        return total


class _Words(dict):
    """Counts of units by text, filled by running the transducer."""

    def __init__(self, transducer: Transducer) -> None:
        self.transducer, self.split = transducer, pretokens().findall

    def fresh(self, unit: str) -> int:
        pieces = self.split(unit)
        return self.transducer.count(unit.encode()) if len(pieces) == 1 else sum(map(self.__getitem__, pieces))

    def __missing__(self, unit: str) -> int:
        n = self.fresh(unit)
        if len(unit) <= 64:
            if len(self) >= MOST_WORDS:
                self.clear()
            self[unit] = n
        return n


class _Spaced(dict):
    """Counts of words after a space, which isn't part of the key, or after a line end, which is."""

    def __init__(self, units: _Words) -> None:
        self.units = units

    def __missing__(self, word: str) -> int:
        n = 1 + self.units.fresh(word[1:]) if word[0] == "\n" else self.units.fresh(" " + word)
        if len(word) <= 64:
            if len(self) >= MOST_WORDS:
                self.clear()
            self[word] = n
        return n


def compose(a: tuple, b: tuple, count) -> tuple:
    """The state map of two neighbouring chunks: (before the first place, tokens between, after the last); the latter two are None where there is no place."""
    if a[1] is None:
        return (a[0] + b[0], *b[1:])
    return (a[0], a[1], a[2] + b[0]) if b[1] is None else (a[0], a[1] + count(a[2] + b[0]) + b[1], b[2])


def prefix_scan(maps: list[tuple], count) -> list[tuple]:
    """All prefixes of the composition, by pairwise reduction (a work-efficient scan)."""
    if len(maps) < 2:
        return maps
    pairs = prefix_scan([compose(maps[i], maps[i + 1], count) for i in range(0, len(maps) - 1, 2)], count)
    out = [maps[0]]
    for i in range(1, len(maps)):
        out.append(pairs[i // 2] if i % 2 else compose(pairs[i // 2 - 1], maps[i], count))
    return out


class Counter:
    """Counts the tokens of whole texts for one vocabulary file."""

    def __init__(self, path: str, chunk: int = CHUNK) -> None:
        self.vocabulary = Vocabulary(path)
        self.units = _Words(Transducer(self.vocabulary))
        self.spaced = _Spaced(self.units)
        self.special = re.compile("|".join(map(re.escape, sorted(self.vocabulary.special, key=len, reverse=True))) or "(?!)")
        self.chunk = chunk

    def closed(self, text: str) -> int:
        """The count of a text that starts and ends in the start state."""
        if _ODD.search(text) or not text:
            return sum(map(self.units.__getitem__, _UNIT.findall(text)))
        # single spaces and line ends only: a unit is a word with what stands before it
        first, *rest = text.replace("\n", " \n").split(" ")
        return self.units[first] + sum(map(self.spaced.__getitem__, rest))

    def state_map(self, text: str) -> tuple:
        first = _SYNC.search(text)
        if not first:
            return text, None, None
        end = len(text)
        while not _SYNC.match(text, end - 1):
            end -= 1
        a, b = first.start(), end - 1
        return text[:a], self.closed(text[a:b]) if b > a else 0, text[b:]

    def segment(self, text: str) -> int:
        if len(text) <= self.chunk:
            return self.closed(text)
        maps = [self.state_map(text[i : i + self.chunk]) for i in range(0, len(text), self.chunk)]
        head, between, tail = self.total(maps)
        return self.closed(head) + (between or 0) + self.closed(tail or "")

    def total(self, maps: list[tuple]) -> tuple:
        """The last prefix; the others are the states at the chunk ends."""
        return prefix_scan(maps, self.closed)[-1]

    def count(self, text: str) -> int:
        """Special strings count one token each and end the text around them, as the library has it."""
        if not self.vocabulary.special or not self.special.search(text):
            return self.segment(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.segment, parts))


def token_counts(df: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 512, chunk: int = CHUNK) -> DataFrame:
    """``keep``, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row.

    ``vocabulary`` is the path of a byte-level BPE file on every executor.  A
    null or empty text has no tokens.  Rows are neither merged nor dropped;
    an empty table gives an empty result.
    """
    schema = T.StructType([df.schema[k] for k in keep]).add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")
    keys = tuple(keep)

    def make(batch: pa.RecordBatch) -> dict:
        counter = remembered(("counter", vocabulary, chunk), lambda: Counter(vocabulary, chunk))
        sizes, counts = [], []
        for t in texts(batch, "__text"):
            sizes.append(len(t.encode()))
            counts.append(counter.count(t))
        return {k: batch.column(i) for i, k in enumerate(keys)} | {"n_bytes": sizes, "n_tokens": counts, "over_limit": [n > limit for n in counts]}

    return arrow_map(df.select(*keys, text_column(df, text).alias("__text")), make, schema)
