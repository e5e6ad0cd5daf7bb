"""Greedy word-piece lengths of texts by a longest-match automaton that never backs up and builds no pieces."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of words whose lengths a worker remembers, with 150 for each entry; beyond it the memory starts afresh.
CACHE = 64 << 20
#: The mark before a word's first piece, as in byte-level vocabularies.
START = b" "


def byte_symbols() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


def read_vocabulary(path: str) -> list[bytes]:
    """The pieces of a tokenizer file with a byte-level vocabulary."""
    symbols = byte_symbols()
    with open(path, encoding="utf-8") as f:
        pieces = json.load(f)["model"]["vocab"]
    return [bytes(symbols[c] for c in p) for p in pieces if all(c in symbols for c in p)]


class Automaton:
    """A trie of the pieces; each node has a failure link and the number of pieces popped on the way there.

    Reading a byte follows the trie where it can. Where it can't, the text read since the last piece is cut into the
    greedy longest pieces, whose count was stored with the node, and reading goes on at the node of what remains.
    A byte is read once, and each failure ends at least one piece, so a word takes time linear in its length.
    """

    def __init__(self, pieces: Iterable[bytes]):
        self.next: list[dict[int, int]] = [{}]
        ends = [False]
        for piece in pieces:
            node = 0
            for b in piece:
                if b not in self.next[node]:
                    self.next[node][b] = len(self.next)
                    self.next.append({})
                    ends.append(False)
                node = self.next[node][b]
            ends[node] = node > 0
        self.fail, self.popped = [-1] * len(ends), [0] * len(ends)
        queue = [0]
        for node in queue:  # breadth first: links of shorter strings are known
            for b, child in self.next[node].items():
                queue.append(child)
                if ends[child]:
                    self.fail[child], self.popped[child] = 0, 1
                    continue
                at, n = self.fail[node], self.popped[node]
                while at >= 0 and b not in self.next[at]:
                    at, n = self.fail[at], n + self.popped[at]
                if at >= 0:
                    self.fail[child], self.popped[child] = self.next[at][b], n

    def count(self, word: bytes) -> int:
        """The pieces of a word, or -1 if no pieces spell it."""
        node, n = 0, 0
        for b in word:
            while b not in self.next[node]:
                n += self.popped[node]
                node = self.fail[node]
                if node < 0 or (node == 0 and b not in self.next[0]):
                    return -1
            node = self.next[node][b]
        while node > 0:
            n += self.popped[node]
            node = self.fail[node]
        return -1 if node < 0 else n


class _Lengths(dict):
    """Word to number of pieces; an unknown word is counted once. At CACHE bytes it starts afresh."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton
        self.held = 0

    def __missing__(self, word: bytes) -> int:
        if self.held > CACHE:
            self.clear()
            self.held = 0
        self.held += len(word) + 150
        self[word] = n = self.automaton.count(START + word)
        return n


_built: dict[str, Automaton] = {}


def automaton_of(path: str) -> Automaton:
    """The automaton of a vocabulary file, built once in a process."""
    if path not in _built:
        _built[path] = Automaton(read_vocabulary(path))
    return _built[path]


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_words, n_tokens, n_unknown.

    Words are what ASCII white space separates. A word counts as the greedy longest pieces of the vocabulary that
    spell it with a space before it; a word that no pieces spell counts as one unknown token. Null, empty and blank
    texts have no words. Repeated rows are counted alike; other columns are not read; an empty table gives no rows.
    vocabulary is a path that every executor has.

    Texts are counted where they are read, without a shuffle; a worker holds one batch and the bounded word memory.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _Lengths(automaton_of(vocabulary))
        for batch in batches:
            rows = []
            for text in batch["text"].cast(pa.large_binary()):
                raw = text.as_py() or b""
                words = raw.split()
                n = list(map(lengths.__getitem__, words))
                unknown = n.count(-1)
                rows.append((len(raw), len(words), sum(n) + 2 * unknown, unknown))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", "n_bytes", "n_words", "n_tokens", "n_unknown"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(counted, f"doc_id {kind}, n_bytes long, n_words long, n_tokens long, n_unknown long")
