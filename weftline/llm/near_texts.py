"""Near-duplicate texts by order MinHash over words and by intact segments, verified by banded alignment."""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.graph import components
from weftline.llm.shared import dropped, saved
from weftline.llm.wordhash import by_bytes, mix, occurrence, split_words

#: Words of a k-mer, k-mers of a sketch, sketches of a text.
K, PICKED, SKETCHES = 3, 2, 40
SIMILARITY = 0.8
#: Sketches with a mark, eight bits of the smallest k-mer, 8 of them in a long; of these so many agree at least in candidates.
MARKS, PER_LONG, AGREE = 40, 8, 4
#: Counts of a text's words by a hash, four bits each up to 15, in so many longs; each edit changes one by one, or two.
COUNTS = 4
#: The columns of marks and counts.
MARKED, COUNTED = [f"m{i}" for i in range(MARKS // PER_LONG)], [f"c{i}" for i in range(COUNTS)]
#: What pairs of nodes are judged by.
SIDES = ["node", "group", "n_words", *MARKED, *COUNTED]
#: Texts of at most so many words, and their partners, are also searched by intact segments, which miss no pair.
SHORT = 20
#: Members of a group that are compared with one another; larger groups are searched in another way.
SMALL = 32
#: Nodes of a block of a larger group; blocks are compared with blocks, in one row.
BLOCK = 512
#: Bytes of text that are sketched at a time.
BATCH = 2 << 20
#: Counters of the words, which order them by rarity, and parts that these are summed in: a bound for what is
#: broadcast. Any order is right.
COUNTERS, COUNTER_PARTS = 1 << 20, 16
#: Words of a run, and how often texts of too many runs that no other group has are left out; slots that hold a bit for
#: runs, four for each of them but within bounds (as logarithms), and slots that are looked at together.
RUN, ROUNDS = 2, 2
LEAST_SLOTS, MOST_SLOTS, SLOTS_PART = 20, 27, 1 << 18
#: Parts that the pairs of one text are dealt to, and the bits that draw a node of a group.
SALTS, DRAW = 16, 0x2AAAAAAAAAAAAAAA
#: Leaders that a text meets first, and pairs of a text that are verified in one part.
LEADERS, MET = 2, 64
_SEEDS = mix(np.arange(1, 1025, dtype=np.uint64)) | np.uint64(1)


def order_sketches(hashes: np.ndarray, first: np.ndarray, k: int = K, sketches: int = SKETCHES) -> tuple[np.ndarray, np.ndarray]:
    """A row of sketches and a row of marks for each text with a word; text t has the word hashes first[t] to first[t + 1].

    A k-mer carries how often it occurred before in its text. Each sketch takes the two k-mers with the smallest
    values of a hash of its own, and hashes them in the order they have in the text. A text of fewer than k words
    is one k-mer; a text with one k-mer has it alone in its sketches. A mark is eight bits of the smallest one, 8 marks
    are one 64-bit number.
    """
    size = np.diff(first)
    kmers = np.maximum(size - k + 1, 1)
    at = np.concatenate([[0], np.cumsum(kmers)])
    text = np.repeat(np.arange(len(size)), kmers)
    start = np.arange(at[-1]) - np.repeat(at[:-1] - first[:-1], kmers)
    value = np.zeros(len(start), np.uint64)
    last = first[1:][text] - 1
    for j in range(k):
        word = np.where(start + j <= last, hashes[np.minimum(start + j, last)], np.uint64(0))
        value = value * np.uint64(0xD6E8FEB86659FD93) + word
    value = mix(value)
    value = mix(value + occurrence(text, value).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    out = np.empty((len(size), sketches), np.uint64)
    marks = np.zeros((len(size), MARKS // PER_LONG), np.uint64)
    top = np.iinfo(np.uint64).max
    for s in range(sketches):
        g = value * _SEEDS[s]
        g ^= g >> np.uint64(32)
        picked = []
        for _ in range(PICKED):
            least = np.minimum.reduceat(g, at[:-1])
            where = np.flatnonzero(g == least[text])
            which = text[where]
            keep = np.append(True, which[1:] != which[:-1])
            picked.append(where[keep])
            g[where[keep]] = top
        if s < MARKS:
            marks[:, s // PER_LONG] |= (mix(value[picked[0]] + np.uint64(s)) >> np.uint64(56)) << np.uint64(s % PER_LONG * 8)
        early, late = np.minimum(*picked), np.maximum(*picked)
        late_value = np.where(early == late, np.uint64(0), value[late])
        out[:, s] = mix(value[early] * np.uint64(0xE7037ED1A0B428DB) + late_value + np.uint64(s))
    return out, marks


def _most(n: int, similarity: float) -> int:
    """Edits between similar texts of which the longer one has n words."""
    return int((1 - similarity) * n + 1e-9)


def segment_keys(words: np.ndarray, similarity: float = SIMILARITY, short: int = SHORT) -> tuple[list[int], list[int]]:
    """Keys of a text as the longer one and as the shorter one of a pair; similar texts share one of each.

    A longer text of n words is cut into one segment more than it may have edits, so that one is left intact. The
    shorter one has it at most that many words away, but no further than the difference of lengths lets the edits be.
    """
    n, own, partner = len(words), [], []
    if not n:
        return own, partner
    kept: dict[tuple[int, int], int] = {}

    def key(longest: int, i: int, a: int, b: int) -> int:
        if (a, b) not in kept:
            kept[a, b] = int.from_bytes(hashlib.blake2b(words[a:b].tobytes(), digest_size=8).digest(), "little", signed=True)
        return (kept[a, b] ^ (longest * 64 + i) * 0x9E3779B97F4A7C15 & (1 << 62) - 1)

    def cuts(longest: int) -> list[tuple[int, int, int]]:
        parts = _most(longest, similarity) + 1
        return [(i, longest * i // parts, longest * (i + 1) // parts) for i in range(parts)]

    if n - _most(n, similarity) <= short:
        own = [key(n, i, a, b) for i, a, b in cuts(n)]
    longest = n
    while n <= short and longest - _most(longest, similarity) <= n:
        most, less = _most(longest, similarity), longest - n
        # of the edits, `less` are deletions at least; the others may move a segment by one for every two
        for i, a, b in cuts(longest):
            for at in range(max(a - less - (most - less) // 2, 0), min(a + (most - less) // 2, n - (b - a)) + 1):
                partner.append(key(longest, i, at, at + b - a))
        longest += 1
    return own, partner


def _labels(words: np.ndarray, run: int = 1) -> np.ndarray:
    """A hash of each run of words of a text and of how often it occurred before; a text of fewer words is one run."""
    n = max(len(words) - run + 1, min(len(words), 1))
    padded, value = np.append(words, np.zeros(run - 1, words.dtype)).astype(np.uint64), np.zeros(n, np.uint64)
    for j in range(run):
        value = value * np.uint64(0xD6E8FEB86659FD93) + padded[j : j + n]
    return mix(value * np.uint64(0x9E3779B97F4A7C15) + occurrence(value).astype(np.uint64))


def rare_labels(labels: np.ndarray, counts: np.ndarray, similarity: float = SIMILARITY, alone: np.ndarray | None = None) -> np.ndarray:
    """The labels of a text that come first in an order by rarity, those that are alone before all; similar texts have
    one of them in common.

    Of the n labels of one, the other holds similarity * n at least, so both can't miss each other's first ones.
    """
    n = len(labels)
    order = np.lexsort((labels, counts[labels & np.uint64(len(counts) - 1)], np.zeros(n, bool) if alone is None else ~alone))
    return labels[order[: _most(n, similarity) + 1]]


def may_lack(n: int, run: int, similarity: float = SIMILARITY) -> int:
    """How many labels of runs of a text of n words a similar text lacks at most.

    A longer one of m words holds m - run + 1 of them, but for run of each of its (1 - similarity) * m edits; that is
    least, beside the n - run + 1 of the text, where m is n.
    """
    return int(run * (1 - similarity) * n + 1e-6)


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Insertions, deletions and replacements between two sequences, or most + 1 if there are more than most.

    Common starts and ends are cut off; the rest is aligned in a band that widens until the edits fit into it.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return most + 1
    same = a == b[: len(a)]
    head = len(a) if same.all() else int(same.argmin())
    a, b = a[head:], b[head:]
    same = a[::-1] == b[len(b) - len(a) :][::-1]
    tail = len(a) if same.all() else int(same.argmin())
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a):
        return len(b) if len(b) <= most else most + 1
    places: dict[int, list[int]] = {}
    for i, w in enumerate(a.tolist()):
        places.setdefault(w, []).append(i)
    other = b.tolist()
    band = min(most, max(64, len(b) - len(a)))
    while (cost := _banded(places, len(a), other, band)) > band and band < most:
        band = min(most, band * 4)
    return cost if cost <= band else most + 1


def _bits(rows: list[int], low: int, width: int) -> int:
    """The rows from low on, as bits."""
    i, j = bisect_left(rows, low), bisect_left(rows, low + width)
    if j - i > 32:
        field = np.zeros(width, np.uint8)
        field[np.array(rows[i:j]) - low] = 1
        return int.from_bytes(np.packbits(field, bitorder="little").tobytes(), "little")
    bits = 0
    for r in rows[i:j]:
        bits |= 1 << (r - low)
    return bits


def _banded(places: dict[int, list[int]], m: int, b: list[int], most: int) -> int:
    """The edits between a sequence of m words, given by the places of each, and b, or more than `most`.

    A band of 2 * most + 1 diagonals is aligned, a column at a time, with the band's differences in the bits of an
    integer: bit i of the band is row column - most + i; plus and minus hold where a row is one more or less than
    that above.
    """
    width = 2 * most + 1
    full = (1 << width) - 1
    diagonal = 1 << most
    plus, minus, cost = full & ~(diagonal - 1), 0, 0
    none: list[int] = []
    for j, w in enumerate(b):
        shift = j - most
        match = _bits(places.get(w, none), shift, width)
        same_diagonal = ((((match & plus) + plus) ^ plus) | match | minus) & full
        more, less = (minus | ~(same_diagonal | plus)) & full, same_diagonal & plus
        if j < m:  # down the main diagonal
            cost += not same_diagonal & diagonal
            if cost > 2 * most:  # any way within the band costs over most
                return most + 1
        else:  # then along the last row
            row = 1 << (m - 1 - shift)
            cost += bool(more & row) - bool(less & row)
        down = same_diagonal >> 1
        plus, minus = (less | ~(down | more)) & full, down & more
    return cost if cost <= most else most + 1


def shared_words(a: np.ndarray, b: np.ndarray) -> int:
    """How many words two sequences have in common, in any order: no alignment matches more."""
    (x, nx), (y, ny) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(nx[i], ny[j]).sum())


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """1 - edit distance / words of the longer one is at least `similarity`."""
    longest = max(len(a), len(b))
    most = _most(longest, similarity)
    if min(len(a), len(b)) < longest - most or shared_words(a, b) < longest - most:
        return False
    return edit_distance(a, b, most) <= most


def word_counts(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """COUNTS longs for each text with a word; text t has the word hashes first[t] to first[t + 1]."""
    bins = COUNTS * 16
    at = np.repeat(np.arange(len(first) - 1), np.diff(first)) * bins + (words % np.uint32(bins))
    n = np.minimum(np.bincount(at, minlength=(len(first) - 1) * bins), 15).astype(np.uint64).reshape(-1, COUNTS, 16)
    return np.bitwise_or.reduce(n << np.arange(0, 64, 4, dtype=np.uint64), axis=2)


def marks_let(n: np.ndarray, m: np.ndarray, x: list[np.ndarray], y: list[np.ndarray], similarity: float) -> np.ndarray:
    """Lengths n and m and marks x and y let two texts be similar; lengths are exact, marks as good as AGREE says and left aside for short texts."""
    agree: np.ndarray | int = 0
    for one, other in zip(x, y, strict=True):
        differ = (one ^ other).view(np.uint64)
        for by in (4, 2, 1):
            differ |= differ >> np.uint64(by)
        agree = agree + PER_LONG - np.bitwise_count(differ & np.uint64(0x0101010101010101)).astype(np.int64)
    least = np.minimum(n, m)
    return (least >= np.maximum(n, m) * similarity - 1e-6) & ((least <= SHORT) | (agree >= AGREE))


def counts_let(longest: np.ndarray, x: list[np.ndarray], y: list[np.ndarray], similarity: float) -> np.ndarray:
    """Word counts x and y let two texts be similar, which is exact: an edit takes one word of either text off at most."""
    more, less = np.zeros(len(longest), np.int64), np.zeros(len(longest), np.int64)
    for one, other in zip(x, y, strict=True):
        for shift in range(0, 64, 4):
            d = (one >> shift & 15) - (other >> shift & 15)
            more += np.maximum(d, 0)
            less += np.maximum(-d, 0)
    return np.maximum(more, less) <= (1 - similarity) * longest + 1e-6


def _let(x: dict[str, np.ndarray], y: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the pairs of rows i of x and j of y word counts let be similar."""
    return counts_let(np.maximum(x["n_words"][i], y["n_words"][j]), [x[c][i] for c in COUNTED], [y[c][j] for c in COUNTED], similarity)


def _columns(rows: pa.StructArray | pa.RecordBatch, prefix: str = "", names: list[str] = SIDES) -> dict[str, np.ndarray]:
    field = rows.column if isinstance(rows, pa.RecordBatch) else rows.field
    return {c: field(f"{prefix}{c}").to_numpy() for c in names}


def _may_link(joined: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of rows with both _side that lengths, marks and word counts let be similar."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_columns(batch, f"{side}_", SIDES[2:]) for side in "ab")
            k = np.flatnonzero(marks_let(x["n_words"], y["n_words"], [x[m] for m in MARKED], [y[m] for m in MARKED], similarity))
            yield batch.select(["a", "b"]).take(pa.array(k[_let(x, y, k, k, similarity)]))

    return joined.mapInArrow(judged, "a long, b long")


def _marks(prefix: str = "") -> list[Column]:
    """A column for each long of marks and word counts."""
    return [F.col("marks")[i].alias(f"{prefix}{c}") for i, c in enumerate([*MARKED, *COUNTED])]


def _side(reps: DataFrame, side: str) -> DataFrame:
    """The length, the marks and the word counts of each text, named for one side of a pair."""
    return reps.select(F.col("node").alias(side), F.col("n_words").alias(f"{side}_n_words"), *_marks(f"{side}_"))


def _possible(pairs: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that lengths and marks let be similar, each once."""
    once = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return _may_link(once.join(_side(reps, "a"), "a").join(_side(reps, "b"), "b"), similarity)


def _keys(reps: DataFrame) -> DataFrame:
    return reps.select("node", F.posexplode("sketches").alias("s", "sketch")).select("node", F.xxhash64("s", "sketch").alias("key"))


def _shared_keys(keyed: DataFrame) -> DataFrame:
    """The keys that several nodes have: their number n, and the lowest, the highest and a drawn node.

    Counts and minima are combined before the shuffle. Keys of the same nodes have the same drawn one.
    """
    drawn = F.min(F.col("node").bitwiseXOR(F.lit(DRAW))).bitwiseXOR(F.lit(DRAW)).alias("drawn")
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low"), F.max("node").alias("high"), drawn).where("n > 1")


def _members(keyed: DataFrame, shared: DataFrame) -> DataFrame:
    """The rows (key, node) of keys that more than two nodes have, with what shared says of them.

    shared is a written table, and the join a shuffle, so Spark can split the rows of a hot key.
    """
    return saved(keyed.join(shared.where("n > 2").drop("high").hint("merge"), "key"), "near-members")


def _with_leaders(shared: DataFrame, members: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """Candidates (a, b): the two nodes of a key, or each node and LEADERS of the lowest and the drawn ones of its keys.

    A node meets those that it has most keys in common with. Keys whose nodes stay apart are searched on, so that no
    pair is lost by this. The pairs of b are dealt to SALTS parts.
    """
    pairs = shared.where("n = 2").select(F.col("high").alias("a"), F.col("low").alias("b"))
    met = members.select(F.col("node").alias("a"), F.explode(F.array("low", "drawn")).alias("b")).where("a <> b")
    often = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("keys")).groupBy("a").agg(F.sort_array(F.collect_list(F.struct((-F.col("keys")).alias("few"), "b"))).alias("led"))
    met = often.select("a", F.explode(F.slice("led", 1, LEADERS)).alias("led")).select("a", "led.b")
    salted = saved(pairs.union(met).distinct().withColumn("salt", _salt()), "near-pairs")
    leads = saved(salted.select("b", "salt").distinct().join(_side(reps, "b"), "b"), "near-leads")
    return _may_link(salted.join(_side(reps, "a"), "a").join(leads, ["b", "salt"]), similarity)


def _salt() -> Column:
    return F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int")


def _grouped(members: DataFrame, groups: DataFrame) -> DataFrame:
    """members with the group that links have put each node into so far."""
    joined = members.join(groups.select("node", "component"), "node", "left")
    return joined.withColumn("group", F.coalesce("component", "node")).drop("component")


def _open(members: DataFrame) -> DataFrame:
    """The keys whose nodes are in several groups."""
    return members.groupBy("key").agg(F.min("group").alias("least"), F.max("group").alias("most")).where("least < most").select("key")


def _sides(reps: DataFrame, groups: DataFrame) -> DataFrame:
    """The columns SIDES of all nodes."""
    return _grouped(reps.select("node", "n_words", *_marks()), groups)


def _pairs_within(rows: DataFrame, similarity: float) -> DataFrame:
    """All pairs (a, b) of different groups with a key in common that lengths and marks let be similar, each once; rows
    of key and SIDES, about SMALL of a key at most. Only such pairs become rows."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            own = batch["own"].flatten()
            c = _columns(own)
            size = pa.compute.list_value_length(batch["own"]).to_numpy()
            later = np.repeat(np.cumsum(size), size) - 1 - np.arange(len(own))  # of the same key
            x = np.repeat(np.arange(len(own)), later)
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(later) - later, later)
            apart = c["group"][x] != c["group"][y]
            x, y = x[apart], y[apart]
            fine = marks_let(c["n_words"][x], c["n_words"][y], [c[m][x] for m in MARKED], [c[m][y] for m in MARKED], similarity)
            x, y = x[fine], y[fine]
            fine = _let(c, c, x, y, similarity)
            a, b = c["node"][x[fine]], c["node"][y[fine]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    lists = rows.groupBy("key").agg(F.collect_list(F.struct(*SIDES)).alias("own"), F.min("group").alias("least"), F.max("group").alias("most"))
    return lists.where("least < most").select("own").mapInArrow(compared, "a long, b long").distinct()


def _counters(rows: DataFrame, labels: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> np.ndarray:
    """How many of the labels of all rows have each of COUNTERS hashes."""
    part = COUNTERS // COUNTER_PARTS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for own in labels(batch):
                np.add.at(n, (own & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
        own = [zlib.compress(np.minimum(x, 2**31 - 1).astype(np.int32).tobytes(), 1) for x in n.reshape(COUNTER_PARTS, part)]
        yield pa.RecordBatch.from_arrays([pa.array(range(COUNTER_PARTS), pa.int32()), pa.array(own, pa.binary())], ["part", "counts"])

    def summed(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(part, np.int64)
        for table in tables:
            for x in table["counts"]:
                total += np.frombuffer(zlib.decompress(x.as_py()), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()], pa.binary())], ["part", "counts"])

    schema = "part int, counts binary"
    parts = rows.mapInArrow(counted, schema).groupBy("part").applyInArrow(summed, schema).collect()  # COUNTER_PARTS rows
    return np.concatenate([np.frombuffer(r.counts, np.int32) for r in sorted(parts, key=lambda r: r.part)] or [np.zeros(COUNTERS, np.int32)])


def _slots(labels: np.ndarray, several: np.ndarray) -> np.ndarray:
    """Which of the labels have a bit in several, of 8 to a byte."""
    at = labels & np.uint64(len(several) * 8 - 1)
    return (several[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _several(texts: DataFrame, run: int, slots: int) -> np.ndarray:
    """A bit for each slot of the labels of runs: whether texts of several groups have it; rows of words and group.

    Labels that share a slot only let the bit be set more often. Slots go by SLOTS_PART to a task.
    """

    def noted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in by_bytes(b, BATCH, "words")):
            own = [_labels(np.frombuffer(raw.as_py(), np.uint32), run) for raw in batch["words"]]
            slot = (np.concatenate(own) & np.uint64(slots - 1)).astype(np.int64)
            group = np.repeat(batch["group"].to_numpy(), [len(x) for x in own])
            order = np.lexsort((group, slot))
            slot, group = slot[order], group[order]
            first = np.flatnonzero(np.diff(slot, prepend=-1))
            last = np.append(first[1:], len(slot)) - 1
            cut = np.searchsorted(slot[first], np.arange(0, slots + 1, SLOTS_PART))
            some = np.flatnonzero(np.diff(cut))
            raw = lambda x: pa.array([zlib.compress(x[cut[i] : cut[i + 1]].tobytes(), 1) for i in some], pa.binary())  # noqa: B023, E731
            columns = [pa.array(some, pa.int32()), raw((slot[first] % SLOTS_PART).astype(np.int32)), raw(group[first]), raw(group[last])]
            yield pa.RecordBatch.from_arrays(columns, ["part", "at", "least", "most"])

    def told(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, most = np.full(SLOTS_PART, np.iinfo(np.int64).max), np.full(SLOTS_PART, np.iinfo(np.int64).min)
        for table in tables:
            for row in zip(*[table[c] for c in ("at", "least", "most")], strict=True):
                at, low, high = (np.frombuffer(zlib.decompress(x.as_py()), t) for x, t in zip(row, (np.int32, np.int64, np.int64), strict=True))
                least[at], most[at] = np.minimum(least[at], low), np.maximum(most[at], high)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(least < most, bitorder="little").tobytes()], pa.binary())], ["part", "bits"])

    noted_rows = texts.select("words", "group").mapInArrow(noted, "part int, at binary, least binary, most binary")
    found = np.zeros((slots // SLOTS_PART, SLOTS_PART // 8), np.uint8)
    for r in noted_rows.groupBy("part").applyInArrow(told, "part int, bits binary").collect():  # a bit for each slot
        found[r.part] = np.frombuffer(r.bits, np.uint8)
    return found.ravel()


def _slots_for(texts: DataFrame) -> int:
    """Four slots for each word, within bounds, as a power of two."""
    n = texts.agg(F.sum("n_words")).first()[0] or 0
    return 1 << min(max((4 * n).bit_length(), LEAST_SLOTS), MOST_SLOTS)


def _not_alone(texts: DataFrame, similarity: float) -> DataFrame:
    """The texts but those that are similar to none of another group, as more of their runs of RUN words than may_lack
    says stand in no other group. What is left is looked at again, ROUNDS times in all. texts is dropped."""
    schema = ", ".join(f"{c} {t}" for c, t in texts.dtypes)
    for _ in range(ROUNDS):
        several = texts.sparkSession.sparkContext.broadcast(_several(texts, RUN, _slots_for(texts)))

        def kept(batches: Iterator[pa.RecordBatch], several=several) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words = [np.frombuffer(raw.as_py(), np.uint32) for raw in batch["words"]]
                keep = [np.count_nonzero(~_slots(_labels(w, RUN), several.value)) <= may_lack(len(w), RUN, similarity) for w in words]
                yield batch.filter(pa.array(keep, pa.bool_()))

        old, texts = texts, saved(texts.mapInArrow(kept, schema), "near-rare-texts")
        dropped(old)
    return texts


def _rare_candidates(crowded: DataFrame, texts: DataFrame, reps: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """All pairs (a, b) of different groups among the crowded nodes that have one of their rarest words in common, and
    that lengths and marks let be similar. Words that more than SMALL nodes have are compared in blocks.

    Nodes that no other group can have a similar text for are left out before, and so are words that one group has.
    Each row of a word carries what its pairs are judged by, and a bound for the number of the word's rows.
    """
    sides = saved(_sides(reps.join(crowded, "node", "left_semi"), groups), "near-rare-sides")
    left = _not_alone(saved(texts.join(sides, "node"), "near-rare-texts"), similarity)
    sizes = saved(left.groupBy("group").agg(F.count(F.lit(1)).alias("own")), "near-rare-groups")
    texts = saved(left.join(sizes, "group"), "near-rare-texts")
    dropped(sides, left, sizes)
    kept = ["own", *SIDES]
    schema = ", ".join(f"{c} {t}" for c, t in texts.select(*kept).dtypes)
    context, labels = texts.sparkSession.sparkContext, lambda raw: _labels(np.frombuffer(raw.as_py(), np.uint32))
    counts = context.broadcast(_counters(texts.select("words"), lambda batch: (labels(raw) for raw in batch["words"])))
    several = context.broadcast(_several(texts, 1, _slots_for(texts)))

    def chosen(raw: pa.Scalar) -> np.ndarray:
        own = labels(raw)
        own = rare_labels(own, counts.value, similarity, ~_slots(own, several.value))
        return own[_slots(own, several.value)]

    number = context.broadcast(_counters(texts.select("words"), lambda batch: (chosen(raw) for raw in batch["words"])))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [chosen(raw) for raw in batch["words"]]
            keys = np.concatenate([*own, np.zeros(0, np.uint64)])
            n = number.value[keys & np.uint64(COUNTERS - 1)]
            at = np.repeat(np.arange(batch.num_rows), [len(k) for k in own])[n > 1]
            rows = batch.select(kept).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(keys[n > 1].view(np.int64)), *rows.columns, pa.array(n[n > 1], pa.int32())], ["key", *kept, "n"])

    keyed = saved(texts.select("words", *kept).mapInArrow(rare, f"key long, {schema}, n int"), "near-rare")
    dropped(texts)
    return _pairs_within(keyed.where(F.col("n") <= SMALL), similarity).union(_in_blocks(keyed.where(F.col("n") > SMALL), similarity)).distinct()


def _in_blocks(rows: DataFrame, similarity: float) -> DataFrame:
    """All pairs (a, b) of different groups with a key in common that lengths and marks let be similar; rows of key, n,
    own and SIDES, of which a key has n at most and a group own.

    A key's nodes are packed in blocks of BLOCK or somewhat more, those of a large group apart from the others. Each
    block of a key meets each other one that is not of the same large group, so that no large group is compared with
    itself, no row or task holds a whole key, and pairs are made only where they may link.
    """
    large = F.col("own") > BLOCK
    most = F.when(large, F.least("own", "n")).otherwise(F.col("n"))
    block = F.pmod(F.xxhash64("node"), F.ceil(most / BLOCK)).cast("int")
    rows = rows.withColumn("apart", F.when(large, F.col("group")).otherwise(F.lit(-1))).withColumn("block", block)
    packed = saved(rows.groupBy("key", "apart", "block").agg(F.collect_list(F.struct(*SIDES)).alias("own")), "near-blocks")
    side = lambda c: packed.select("key", F.col("apart").alias(f"{c}_apart"), F.col("block").alias(f"{c}_block"))
    first = F.struct("x_apart", "x_block") <= F.struct("y_apart", "y_block")
    met = saved(side("x").join(side("y"), "key").where(first & ((F.col("x_apart") < 0) | (F.col("x_apart") != F.col("y_apart")))), "near-block-pairs")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, other in zip(batch["x"], batch["y"], strict=True):
                x, y = (_columns(s.values) for s in (one, other))
                fine = marks_let(x["n_words"][:, None], y["n_words"][None, :], [x[m][:, None] for m in MARKED], [y[m][None, :] for m in MARKED], similarity)
                i, j = np.nonzero(fine & (x["group"][:, None] != y["group"][None, :]))
                fine = _let(x, y, i, j, similarity)
                a, b = x["node"][i[fine]], y["node"][j[fine]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    for c in ("x", "y"):
        met = met.join(packed.select("key", F.col("apart").alias(f"{c}_apart"), F.col("block").alias(f"{c}_block"), F.col("own").alias(c)), ["key", f"{c}_apart", f"{c}_block"])
    return met.select("x", "y").mapInArrow(compared, "a long, b long")


def _drawn_of_largest(members: DataFrame, similarity: float) -> DataFrame:
    """Of the keys with more than SMALL nodes in several groups: pairs (a, b) of each node whose group has at most SMALL
    there, and of one node of each larger group, with a drawn node of the key's largest group, where they may link. They
    spare the search in blocks most of the texts beside a large group. Rows of key, n and SIDES."""
    large = members.where(F.col("n") > SMALL).select("key", *SIDES)
    own = F.struct(*[c for c in SIDES if c != "group"])
    drawn = F.min(F.struct(F.xxhash64("key", "node").alias("h"), own.alias("own")))["own"].alias("drawn")
    by_group = saved(large.groupBy("key", "group").agg(F.count(F.lit(1)).alias("own"), drawn), "near-by-group")
    most = by_group.groupBy("key").agg(F.max_by("drawn", F.struct("own", "group")).alias("b"), F.max("own").alias("own"), F.count(F.lit(1)).alias("groups"))
    most = saved(most.where((F.col("own") > SMALL) & (F.col("groups") > 1)).select("key", "b"), "near-most")
    few = large.join(by_group.where(F.col("own") <= SMALL).select("key", "group"), ["key", "group"], "left_semi").select("key", own.alias("a"))
    few = saved(few.union(by_group.where(F.col("own") > SMALL).select("key", F.col("drawn").alias("a"))), "near-few")
    met = few.join(most, "key").where("a.node <> b.node")
    columns = [F.col(f"{side}.{c}").alias(side if c == "node" else f"{side}_{c}") for side in "ab" for c in SIDES if c != "group"]
    return _may_link(met.select(*columns), similarity).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _short_candidates(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of different groups with an intact segment in common; rows of (node, group, own, partner)."""
    side = lambda c, keys: rows.select(F.col("node").alias(c), F.col("group").alias(f"{c}_group"), F.explode(keys).alias("key")).distinct()
    return side("a", "own").join(side("b", "partner"), "key").where("a_group <> b_group").select("a", "b").distinct()


def _segments(rows: DataFrame, similarity: float) -> DataFrame:
    """node and the segment_keys own and partner of the texts that are short or may have a short partner."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [segment_keys(np.frombuffer(w.as_py(), np.uint32), similarity) for w in batch["words"]]
            columns = [pa.array([k[i] for k in keys], pa.list_(pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch["node"], *columns], ["node", "own", "partner"])

    some = rows.where(F.col("n_words") * similarity <= SHORT + 1).select("node", "words")
    return some.mapInArrow(made, "node long, own array<long>, partner array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose words align; pairs is a written table. A text's pairs are dealt to parts of MET, so that a leader
    of many is in no single task and the words of others are sent once."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = lambda x: np.frombuffer(x.as_py(), np.uint32)
            keep = [similar(read(x), read(y), similarity) for x, y in zip(batch["wa"], batch["wb"], strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    parts = saved(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / MET).cast("int").alias("parts")), "near-parts")
    salted = pairs.join(parts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("salt"))
    words = lambda side: texts.select(F.col("node").alias(side), F.col("words").alias(f"w{side}"))
    ones = salted.join(words("a"), "a")
    others = parts.join(words("b"), "b").select("b", "wb", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    return ones.join(others, ["b", "salt"]).select("a", "b", "wa", "wb").mapInArrow(checked, "a long, b long")


def near_texts(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each document: doc_id, n_words, class_id, class_size and kept.

    Documents are linked if their texts are equal, or if an alignment of their words needs at most 1 - similarity of
    the longer one's words as insertions, deletions and replacements. class_id is the smallest doc_id that links lead
    to, class_size the number of rows there, kept is true for one row of each class, that of the smallest doc_id.
    Null and empty texts are equal to one another and similar to nothing else; so are texts of white space only, each
    to its copies. Rows with a null doc_id take part; they are kept where all of a class are null. Repeated rows are
    copies. Other columns are not read; an empty table gives no rows.

    Equal texts are sketched as one. Each sketch has PICKED k-mers of K words in text order. Texts with a sketch in
    common first meet two of them; the links found make groups. Sketches whose texts are still in several groups are
    searched on: small ones pair by pair; in larger ones, texts beside a large group meet one of it, and what stays
    apart meets all texts of other groups with a rare word in common, however many have it. Of two similar texts,
    each holds one of the other's rarest words, and most of its runs of RUN words, so that search misses none. Texts of up to SHORT words meet every text
    that they may be linked to by an intact segment, which misses none. For others at 0.8, with edits at random places, 0.12 of the sketches are equal,
    and none is with a chance of 0.007; if the edits spare as few k-mers as can be, of 0.08.
    """
    rows = saved(sketched(docs), "near-rows")
    id_type = dict(docs.dtypes)["doc_id"]
    nodes = saved(rows.groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")), "near-texts")
    reps = rows.where("n_words > 0").select(F.col("row").alias("node"), F.col("n_words").cast("int"), "sketches", "marks").join(nodes.select("node").hint("merge"), "node", "left_semi")
    reps = saved(reps, "near-sketches")

    keyed = _keys(reps)
    shared = saved(_shared_keys(keyed), "near-keys")
    members = _members(keyed, shared)
    pairs = saved(_with_leaders(shared, members, reps, similarity), "near-possible")
    # words are fetched many times, so only of the texts that any search may lead to
    pool = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(members.select("node"))
    pool = saved(pool.union(reps.where(F.col("n_words") * similarity <= SHORT + 1).select("node")).distinct(), "near-pool")
    texts = rows.select(F.col("row").alias("node"), F.col("n_words").cast("int"), "words")
    texts = saved(texts.join(pool, "node", "left_semi"), "near-words")
    found = saved(_verified(pairs, texts, similarity), "near-found")
    groups = saved(components(found), "near-groups")
    grouped = saved(members.select("key", "node", "n").join(saved(_sides(reps, groups), "near-sides"), "node"), "near-grouped")
    dropped(members, found, shared)
    members, met = grouped, pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    segments = saved(_grouped(_segments(texts, similarity), groups), "near-segments")
    pairs = _drawn_of_largest(members, similarity).union(_possible(_short_candidates(segments), reps, similarity))
    pairs = saved(pairs.union(_pairs_within(members.where(F.col("n") <= SMALL), similarity)).distinct(), "near-pairs")
    more = saved(_verified(pairs, texts, similarity), "near-more")
    comps = saved(components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)), "near-components")
    # what has a sketch in common with more than SMALL texts and with several groups still is searched by rare words
    rest = saved(_grouped(members.where(F.col("n") > SMALL).select("key", "node"), comps), "near-rest")
    crowded = saved(rest.join(saved(_open(rest), "near-open"), "key", "left_semi").select("node").distinct(), "near-crowded")
    if not crowded.isEmpty():
        old, left = comps, _rare_candidates(crowded, texts.select("node", "words"), reps, comps, similarity)
        left = saved(left.join(met.union(pairs), ["a", "b"], "left_anti"), "near-left")  # those are not similar
        links = saved(_verified(left, texts, similarity), "near-links")
        comps = saved(components(old.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links)), "near-components")
        dropped(left, links, old)
    dropped(rest, crowded)
    dropped(members, groups, segments, pairs, more, texts, pool, reps)

    nodes = saved(nodes.join(comps, "node", "left").withColumn("group", F.coalesce("component", "node")), "near-nodes")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("doc_id")))
    # written tables on both sides, so that Spark can split the rows of a large class or of a text with many copies
    classes = saved(nodes.groupBy("group").agg(best["doc_id"].alias("class_id"), F.sum("copies").alias("class_size")), "near-classes")
    of_text = saved(nodes.select("digest", "group").join(classes, "group"), "near-of-text")
    out = saved(rows.select("row", "doc_id", "n_words", "digest").join(of_text, "digest"), "near-out")
    first = out.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("group").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("first"))
    return out.join(first, "row", "left").select(F.col("doc_id").cast(id_type), "n_words", "class_id", "class_size", F.coalesce("first", F.lit(False)).alias("kept"), "row")


def sketched(docs: DataFrame) -> DataFrame:
    """Row number, doc_id, digest of the text, n_words, 32-bit word hashes, sketches and marks of each document."""
    kind = dict(docs.dtypes)["doc_id"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in by_bytes(b, BATCH)):
            w = split_words(batch["text"])
            hashes, size = w.hashes(), np.diff(w.first)
            some = np.flatnonzero(size)
            sketches, marks = [None] * len(size), [None] * len(size)
            if len(some):
                first = np.concatenate([[0], np.cumsum(size[some])])
                tables = order_sketches(hashes, first)
                tables = tables[0], np.hstack([tables[1], word_counts((hashes >> np.uint64(32)).astype(np.uint32), first)])
                for i, row, mark in zip(some, *[t.view(np.int64) for t in tables], strict=True):
                    sketches[i], marks[i] = row, mark
            short = (hashes >> np.uint64(32)).astype(np.uint32)
            words = [short[a:b].tobytes() for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
            digest = [hashlib.md5(t.as_py() or b"").digest() for t in batch["text"].cast(pa.large_binary())]
            columns = [batch["doc_id"], pa.array(digest, pa.binary()), pa.array(size, pa.int64()), pa.array(words, pa.binary()), pa.array(sketches, pa.list_(pa.int64())), pa.array(marks, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "n_words", "words", "sketches", "marks"])

    out = docs.select("doc_id", "text").mapInArrow(made, f"doc_id {kind}, digest binary, n_words long, words binary, sketches array<long>, marks array<long>")
    return out.withColumn("row", F.monotonically_increasing_id())


def without_near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class of near_texts, with the columns of docs.

    The rows are numbered in a table written first, so that the document kept is a row even if doc_ids repeat.
    """
    numbered = saved(docs.withColumn("__row", F.monotonically_increasing_id()), "near-input")
    verdicts = near_texts(numbered.select(F.col("__row").alias("doc_id"), "text"), similarity)
    kept = saved(verdicts.where("kept").select(F.col("doc_id").alias("__row")), "near-kept")
    return numbered.join(kept, "__row", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
