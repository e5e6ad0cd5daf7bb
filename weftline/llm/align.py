"""Alignment of two tokenizers' tokens by their byte boundaries, and how often tokens are linked over a corpus."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.packing import encoder_of
from weftline.llm.shared import saved
from weftline.llm.token_count import byte_symbols
from weftline.llm.wordhash import by_bytes

#: Bytes of texts that are aligned together at most, but for a longer text alone, and that are cut at a time.
BLOCK, STEP = 4 << 20, 1 << 20
#: Parts that a task remembers at most between two blocks, some 300 bytes each; beyond it the memory starts afresh.
REMEMBERED = 200_000
#: Groups of more links count equal ids before they are multiplied.
LARGE = 64
#: Labels of a byte: no token ends behind it, one of A, one of B, one of each.
NONE, A_END, B_END, BOTH = b"nabc"
SPAN = re.compile(rb"[^c]*c")
#: Where a text can be cut: both kinds of tokenizer start a token at a space that stands alone between other characters.
CUT = re.compile(r"(?<=\S)(?= \S)")


class Pair:
    """A byte-level tokenizer file (A) and a piece model with a space before the text (B)."""

    def __init__(self, a: str, b: str):
        self.a = encoder_of(a)
        symbols = byte_symbols()
        vocabulary = self.a.tokenizer.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            if piece not in self.a.added:
                self.a_bytes[i] = bytes(symbols[c] for c in piece)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        #: Whether pieces hold spaces at their start only, so that no piece goes across a cut.
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)

    def parts(self, text: str) -> list[str]:
        """The text with a space before it, cut where tokens of both kinds end."""
        return CUT.split(" " + text) if self.cuts else [" " + text]

    def a_ids(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of parts that start with a space, and how many each has. Most parts are lines of one text; not those with a line end, or other space at an end."""
        encode, line = self.a.encoding.encode_ordinary, self.a.line
        plain = [len(p) > 1 and "\n" not in p and not p[1].isspace() and not p[-1].isspace() for p in parts]
        lines = [p for p, x in zip(parts, plain, strict=True) if x]
        flat = np.concatenate([np.array(encode("\n".join(["", *lines[at : at + 10_000]])), np.int64) for at in range(0, len(lines), 10_000)] or [np.zeros(0, np.int64)])
        ends = np.flatnonzero(flat == line)
        n = np.zeros(len(parts), np.int64)
        n[plain] = np.diff(np.append(ends, len(flat))) - 1
        flat = flat[flat != line]
        others = {i: np.array(encode(parts[i]), np.int64) for i, x in enumerate(plain) if not x}
        if others:
            before = np.cumsum(n) - n
            flat = np.insert(flat, np.repeat([before[i] for i in others], [len(x) for x in others.values()]), np.concatenate([*others.values()]))
            n[list(others)] = [len(x) for x in others.values()]
        return flat, n

    def b_ids(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.b.encode([p[1:] for p in parts], num_threads=1)
        n = np.array([*map(len, ids)], np.int64)
        return np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())), n

    def groups(self, parts: list[str]) -> Groups:
        """The groups of parts; a part that either kind doesn't spell has none.

        The parts' bytes are labelled in one string; each part ends with a label of both kinds.
        """
        raw = [p.encode() for p in parts]
        size, ids, counts, tokens, spelled = np.array([*map(len, raw)], np.int64), [], [], [], np.ones(len(parts), bool)
        for table, (flat, n) in ((self.a_bytes, self.a_ids(parts)), (self.b_bytes, self.b_ids(parts))):
            found = [table[i] for i in flat.tolist()]
            if b"".join(found) != b"".join(raw) or (_sums(np.array([*map(len, found)], np.int64), n) != size).any():
                ends = np.cumsum(n).tolist()
                spelled &= np.array([b"".join(found[end - k : end]) == p for end, k, p in zip(ends, n.tolist(), raw, strict=True)], bool)
            ids.append(flat)
            counts.append(n)
            tokens.append(found)
        fine = np.flatnonzero(spelled)
        ids = [x[np.repeat(spelled, n)] for x, n in zip(ids, counts, strict=True)]
        ends = [np.cumsum([len(t) for t, x in zip(found, np.repeat(spelled, n).tolist(), strict=True) if x], dtype=np.int64) for found, n in zip(tokens, counts, strict=True)]
        labels = np.full(int(size[fine].sum()), NONE, np.uint8)
        labels[ends[0] - 1] = A_END
        labels[ends[1] - 1] = np.where(labels[ends[1] - 1] == A_END, BOTH, B_END)
        length = np.array([*map(len, SPAN.findall(labels.tobytes()))], np.int64)
        last = np.cumsum(length) - 1
        at = [np.concatenate([[0], np.cumsum((labels == own) | (labels == BOTH))[last]]).astype(np.int64) for own in (A_END, B_END)]
        return Groups(np.repeat(fine, size[fine])[last], length, *(y for x in at for y in (x[:-1], np.diff(x))), *ids)


@dataclass(frozen=True)
class Groups:
    """For each group its part, its bytes, and the first and the number of its ids of A and of B."""

    part: np.ndarray
    length: np.ndarray
    a_at: np.ndarray
    a_n: np.ndarray
    b_at: np.ndarray
    b_n: np.ndarray
    a: np.ndarray
    b: np.ndarray

    def texts(self) -> list[str]:
        """Each group's ids as text."""
        one, two = self.a.tolist(), self.b.tolist()
        places = zip(self.a_at.tolist(), self.a_n.tolist(), self.b_at.tolist(), self.b_n.tolist(), strict=True)
        return [f"{one[i]}|{two[j]}" if n == m == 1 else f"{','.join(map(str, one[i : i + n]))}|{','.join(map(str, two[j : j + m]))}" for i, n, j, m in places]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(part, pair of ids, how often) of the links, in the order of the parts; a pair may come again."""
        n = self.a_n * self.b_n
        small = n <= LARGE
        g = np.repeat(np.flatnonzero(small), n[small])
        k = np.arange(len(g)) - np.repeat(np.cumsum(n[small]) - n[small], n[small])
        keys = self.a[self.a_at[g] + k // self.b_n[g]] << 32 | self.b[self.b_at[g] + k % self.b_n[g]]
        parts, times = [self.part[g]], [np.ones(len(g), np.int64)]
        keys = [keys]
        for i in np.flatnonzero(~small):
            x, x_n = np.unique(self.a[self.a_at[i] :][: self.a_n[i]], return_counts=True)
            y, y_n = np.unique(self.b[self.b_at[i] :][: self.b_n[i]], return_counts=True)
            keys.append((x[:, None] << 32 | y[None, :]).ravel())
            times.append((x_n[:, None] * y_n[None, :]).ravel())
            parts.append(np.full(len(keys[-1]), self.part[i]))
        part = np.concatenate(parts)
        order = np.argsort(part, kind="stable")
        return part[order], np.concatenate(keys)[order], np.concatenate(times)[order]


def _sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The sums of runs of n values each."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(n)
    return total[ends] - total[ends - n]


class Parts:
    """What a worker knows of the parts it met: their groups as text, their numbers, and the pairs of ids they link."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.known: dict[str, int] = {}
        self.digests: list[bytes | None] = []  # None if the part can't be spelled
        self.figures = array("q")  # tokens of A and B, groups and links of each part
        self.at, self.keys, self.times = array("q", [0]), array("q"), array("q")

    def learn(self, parts: list[str]) -> None:
        new = [p for p in dict.fromkeys(parts) if p not in self.known]
        if not new:
            return
        found = self.pair.groups(new)
        texts, n_groups = found.texts(), np.bincount(found.part, minlength=len(new))
        first = 0
        for part, end in zip(new, np.cumsum(n_groups).tolist(), strict=True):
            self.known[part] = len(self.known)
            self.digests.append(";".join(texts[first:end]).encode() if end > first else None)
            first = end
        n_links = found.a_n * found.b_n
        self.figures.frombytes(np.stack([*(_sums(x, n_groups) for x in (found.a_n, found.b_n)), n_groups, _sums(n_links, n_groups)], 1).tobytes())
        of_part, keys, times = found.links()
        self.at.frombytes((len(self.keys) + np.cumsum(np.bincount(of_part, minlength=len(new)))).tobytes())
        self.keys.frombytes(keys.tobytes())
        self.times.frombytes(times.tobytes())


class Block:
    """Texts that are aligned together, by the parts that they consist of."""

    def __init__(self, parts: Parts):
        self.parts = parts
        self.doc_ids: list = []
        self.rows: list[tuple] = []
        self.doc_parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, doc_ids: list, texts: list[str | None]) -> None:
        cut = [self.parts.pair.parts(t) if t else [] for t in texts]
        self.parts.learn([p for parts in cut for p in parts])
        figures = np.frombuffer(self.parts.figures, np.int64).reshape(-1, 4).copy()
        known, digests = self.parts.known, self.parts.digests
        self.doc_ids += doc_ids
        for parts in cut:
            which = [known[p] for p in parts]
            spelled = [digests[i] for i in which]
            if not parts or None in spelled:
                self.rows.append((0, 0, 0, 0, ""))
                self.doc_parts.append((np.zeros(0, np.int64),) * 2)
                continue
            entries, n = np.unique(which, return_counts=True)
            self.rows.append((*(figures[entries] * n[:, None]).sum(0).tolist(), hashlib.sha256(b";".join(spelled)).hexdigest()))
            self.doc_parts.append((entries, n))

    def packed(self, number: int, kind: pa.DataType) -> pa.RecordBatch:
        """One row: the documents' figures, their parts, the parts' pairs, and in how many documents each pair stands."""
        raw = lambda x, t: pa.array([np.asarray(x, t).tobytes()], pa.binary())
        used, d_part = np.unique(np.concatenate([e for e, _ in self.doc_parts]), return_inverse=True)
        at = np.array(self.parts.at, np.int64)
        p_at = np.concatenate([[0], np.cumsum(at[used + 1] - at[used])])
        pairs, p_pair = np.unique(_slices(np.array(self.parts.keys, np.int64), at, used), return_inverse=True)
        times = _slices(np.array(self.parts.times, np.int64), at, used)
        more = np.flatnonzero(times > 1)
        d_at = np.cumsum([0, *(len(e) for e, _ in self.doc_parts)])
        seen = np.zeros(len(pairs), np.int64)
        for a, b in zip(d_at, d_at[1:], strict=False):
            seen[np.unique(_slices(p_pair, p_at, d_part[a:b]))] += 1
        rows = list(zip(*self.rows, strict=True))
        columns = [pa.array([number], pa.int64()), raw(pairs, np.int64), raw(seen, np.int64), pa.array([self.doc_ids], pa.list_(kind)), raw(np.array(rows[:4], np.int64).T, np.int64), pa.array([list(rows[4])], pa.list_(pa.string()))]
        columns += [raw(d_at, np.int64), raw(d_part, np.int32), raw(np.concatenate([n for _, n in self.doc_parts]), np.int32), raw(p_at, np.int64), raw(p_pair, np.int32), raw([more, times[more]], np.int64)]
        return pa.RecordBatch.from_arrays(columns, ["block", "pairs", "seen", "doc_ids", "figures", "digests", "d_at", "d_part", "d_n", "p_at", "p_pair", "p_more"])


def _slices(values: np.ndarray, at: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The values of several runs that start and end at `at`."""
    n = at[entries + 1] - at[entries]
    ends = np.cumsum(n)
    return values[np.repeat(at[entries] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


_pairs: dict[tuple[str, str], Pair] = {}


def pair_of(a: str, b: str) -> Pair:
    """The tokenizers of two files, read once in a process."""
    if (a, b) not in _pairs:
        _pairs[a, b] = Pair(a, b)
    return _pairs[a, b]


def token_groups(docs: DataFrame, a: str, b: str) -> DataFrame:
    """(doc_id, start, end, a_ids, b_ids) of every group of every document: byte offsets in the text with a space before it.

    Texts without tokens, as `align_tokens` has them, give no rows.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(a, b)
        for batch in (part for x in batches for part in by_bytes(x, BLOCK)):
            for i, text in enumerate(batch["text"].to_pylist()):
                found = pair.groups(pair.parts(text) if text else [])
                end = np.cumsum(found.length)
                if text and found.length.sum() == len(text.encode()) + 1:
                    lists = lambda x, at: pa.ListArray.from_arrays(pa.array(np.append(at, len(x)), pa.int32()), pa.array(x, pa.int32()))
                    yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array([i] * len(end))), pa.array(end - found.length), pa.array(end), lists(found.a, found.a_at), lists(found.b, found.b_at)], ["doc_id", "start", "end", "a_ids", "b_ids"])

    return docs.select("doc_id", "text").mapInArrow(grouped, f"doc_id {kind}, start long, end long, a_ids array<int>, b_ids array<int>")


def _blocks(docs: DataFrame, a: str, b: str) -> DataFrame:
    kind = dict(docs.dtypes)["doc_id"]

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, task, made, held = pair_of(a, b), TaskContext.get().partitionId(), 0, 0
        block, kept = Block(Parts(pair)), None
        for batch in (part for x in batches for part in by_bytes(x, STEP)):
            size = batch["text"].nbytes
            if held and held + size > BLOCK:
                yield block.packed(task << 32 | made, kept)
                block, made, held = Block(Parts(pair) if len(block.parts.known) > REMEMBERED else block.parts), made + 1, 0
            kept = batch["doc_id"].type
            block.add(batch["doc_id"].to_pylist(), batch["text"].to_pylist())
            held += size
        if block.doc_ids:
            yield block.packed(task << 32 | made, kept)

    schema = f"block long, pairs binary, seen binary, doc_ids array<{kind}>, figures binary, digests array<string>, d_at binary, d_part binary, d_n binary, p_at binary, p_pair binary, p_more binary"
    return docs.select("doc_id", "text").mapInArrow(aligned, schema)


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, pairs, seen in zip(batch["block"], batch["pairs"], batch["seen"], strict=True):
            keys, n = np.frombuffer(pairs.as_py(), np.int64), np.frombuffer(seen.as_py(), np.int64)
            for at in range(0, len(keys), 1 << 16):
                some = keys[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), block.as_py())), pa.array(some), pa.array(n[at : at + (1 << 16)])], ["block", "pair", "n"])


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, n_docs, is_best): in how many documents a pair of ids is linked, and whether no pair with its A id is in more."""
    each = blocks.select("block", "pairs", "seen").mapInArrow(_seen, "block long, pair long, n long").where("n > 0")
    counts = saved(each.groupBy("pair").agg(F.sum("n").alias("n_docs")), "pair-counts")
    of_a = F.shiftright("pair", 32).cast("int")
    best = saved(counts.groupBy(of_a.alias("a")).agg(F.max("n_docs").alias("best")), "pair-best")
    # one row for each entry of A's vocabulary at most
    return counts.withColumn("a", of_a).join(F.broadcast(best), "a").select("pair", "n_docs", (F.col("n_docs") == F.col("best")).alias("is_best"))


def align_tokens(docs: DataFrame, a: str, b: str) -> DataFrame:
    """One row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    A reads a space and the text, B the text, to which it adds the space; strings of special tokens are plain text.
    Each byte is labelled by the tokens that end there; a group goes up to a byte where tokens of both end. A link is
    a pair of an A and a B token of one group; its count is the number of documents in which its ids are linked. n_best
    are the links whose count is the highest of their A id, ties included; count_sum adds up the counts of all links.
    Null and empty texts, and texts that either kind doesn't spell exactly, have no tokens: zeros and ''. Repeated rows
    count each; other columns are not read; an empty table gives no rows. A very long text is a block of its own.
    a and b are paths that every executor has.

    Texts are cut at single spaces, where a token of each kind starts, and each different part of a block of texts is
    encoded and aligned once. Blocks are written. Only the different pairs of each block are shuffled to be counted,
    and again with their counts to the block's row, which stays below the size of its texts but for a few columns.
    """
    kind = dict(docs.dtypes)["doc_id"]
    blocks = saved(_blocks(docs, a, b), "aligned-blocks", wide=True)
    each = blocks.select("block", "pairs", "seen").mapInArrow(_seen, "block long, pair long, n long").select("block", "pair")
    counted = each.join(saved(pair_counts(blocks), "pair-figures"), "pair").select("block", "pair", "n_docs", "is_best")

    def figured(blocks: pa.Table, counts: pa.Table) -> pa.Table:
        parts = [_figures(row, counts) for row in blocks.to_pylist()]
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        columns = [[x for p in parts for x in p[i]] for i in range(len(names))]
        ids = blocks["doc_ids"].type.value_type if len(parts) else pa.int64()
        return pa.table([pa.array(columns[0], ids), *(pa.array(c, pa.int64()) for c in columns[1:7]), pa.array(columns[7], pa.string())], names=names)

    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return blocks.drop("seen").groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(figured, schema)


def _figures(row: dict, counts: pa.Table) -> list:
    """The columns of a block's documents, from the block and the counts of its pairs."""
    at = lambda name, kind: np.frombuffer(row[name], kind)
    pairs = at("pairs", np.int64)
    order = np.argsort(pairs)
    n_docs, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    where = order[np.searchsorted(pairs, counts["pair"].to_numpy(), sorter=order)] if len(pairs) else []
    n_docs[where], best[where] = counts["n_docs"].to_numpy(), counts["is_best"].to_numpy()
    p_at, p_pair = at("p_at", np.int64), at("p_pair", np.int32)
    where, times = at("p_more", np.int64).reshape(2, -1)  # links of a part that come more than once
    p_n = np.ones(len(p_pair), np.int64)
    p_n[where] = times
    sums = lambda x, ends: np.diff(np.concatenate([[0], np.cumsum(x)])[ends])  # noqa: E731  of runs
    part_best, part_sum = sums(p_n * best[p_pair], p_at), sums(p_n * n_docs[p_pair], p_at)
    d_at, d_part, d_n = at("d_at", np.int64), at("d_part", np.int32), at("d_n", np.int32)
    figures = at("figures", np.int64).reshape(-1, 4)
    return [row["doc_ids"], *(figures[:, i].tolist() for i in range(4)), sums(d_n * part_best[d_part], d_at).tolist(), sums(d_n * part_sum[d_part], d_at).tolist(), row["digests"]]
