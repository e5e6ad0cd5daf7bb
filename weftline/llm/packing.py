"""Packing of tokenised documents into sequences, with sources in proportion by deficit round-robin."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenizers import Tokenizer

from weftline.llm.shared import saved
from weftline.llm.token_count import byte_symbols
from weftline.llm.wordhash import by_bytes

#: Tokens of a sequence, and of a window in which the sources stand in proportion.
SEQUENCE, WINDOW = 1024, 16 * 1024
#: Tokens that a window holds for each source at least; with very many sources the windows are longer.
LEAST = 4
#: The token behind each document.
END = 0
#: Bytes of words whose ids a worker remembers, and of rounds that a worker keeps; beyond it the memory starts afresh.
CACHE, KEPT = 32 << 20, 16 << 20

# The pattern that byte-level vocabularies cut texts by, and a text to try.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PROBE = "The  cat's 2nd \u00e9tude,\n\n\t <|end|> na\u00efve\u2019s \u4f60\u597d \U0001f600 don't WE'LL x=1;\r\n  end "


class Encoder:
    """Ids of texts by a byte-level tokenizer file, as bytes of unsigned 32-bit numbers.

    Such tokenizers join white space to nothing before it, and to what stands behind it no more than one space. So a
    batch of texts is cut at its spaces, each different part is encoded once, and its ids are remembered. A text in
    which a space stands beside other white space, or at an end, is encoded as a whole.
    Parts are merged by tiktoken, ten times as fast on short ones, over the file's own vocabulary, whose ids are the
    order of the merges; that the two libraries agree is checked on a text when the file is read.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        symbols, vocabulary = byte_symbols(), self.tokenizer.get_vocab()
        ranks = {bytes(symbols[c] for c in piece): i for piece, i in vocabulary.items() if piece not in self.added and all(c in symbols for c in piece)}
        #: The numbers that ids are kept in.
        self.kind = "<u2" if max(vocabulary.values(), default=0) < 1 << 16 else "<u4"
        self.encoding = tiktoken.Encoding("parts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        if self._ids(PROBE) != self._slow(PROBE):
            raise ValueError(f"{path} is not a byte-level vocabulary with ids in the order of its merges")
        (self.line,) = self._ids("\n")
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _slow(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _ids(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def _lookup(self, parts: list[str]) -> list[bytes]:
        """The ids of parts with a space before them; new ones are encoded as lines of one text."""
        if self.held > CACHE:
            self.known.clear()
            self.held = 0
        new = [p for p in parts if p not in self.known]
        self.held += sum(map(len, new)) + 100 * len(new)
        lines = [p for p in new if "\n" not in p]
        for at in range(0, len(lines), 10_000):
            some = lines[at : at + 10_000]
            ids = np.array(self._ids("\n ".join(["", *some])), "<u4")
            cuts = 4 * np.flatnonzero(ids == self.line)
            raw = ids.tobytes()
            self.known |= {p: raw[a:b] for p, a, b in zip(some, (cuts + 4).tolist(), [*cuts[1:].tolist(), len(raw)], strict=True)}
        self.known |= {p: np.array(self._ids(" " + p), "<u4").tobytes() for p in new if "\n" in p}
        return list(map(self.known.__getitem__, parts))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; the array has no nulls."""
        cut = pc.split_pattern(texts.cast(pa.large_string()), " ")
        bounds = cut.offsets.to_numpy()
        parts = cut.flatten().dictionary_encode()
        entries, which = parts.dictionary.to_pylist(), parts.indices.to_numpy().astype(np.int64)
        # parts that can't be encoded by themselves: empty ones, and those with white space at an end
        apart = np.array([not p or p[0].isspace() or p[-1].isspace() for p in entries], bool)
        ids = self._lookup(["-" if x else p for p, x in zip(entries, apart, strict=True)])
        alone = np.logical_or.reduceat(apart[which], bounds[:-1]) if len(texts) else apart[:0]
        # a text's first part has no space before it
        first: dict[int, int] = {}
        for i in bounds[:-1][~alone].tolist():
            entry = int(which[i])
            if entry not in first:
                first[entry] = len(ids)
                ids.append(np.array(self._ids(entries[entry]), "<u4").tobytes())
            which[i] = first[entry]
        size = np.array([len(x) // 4 for x in ids])
        flat, at = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size
        n = size[which]
        end = np.cumsum(n)
        all_ids = flat[np.repeat(at[which] - (end - n), n) + np.arange(end[-1] if len(end) else 0)]
        edges = np.concatenate([[0], end])[bounds]
        out = [all_ids[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        special = np.zeros(len(texts), bool)
        for token in self.added:
            special |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(alone | special).tolist():
            out[i] = np.array((self._slow if special[i] else self._ids)(texts[i].as_py()), "<u4")
        return out


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The encoder of a tokenizer file, made once in a process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenised(docs: DataFrame, tokenizer: str, batch_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, source, task, before, n_tokens and ids of each document, END behind it.

    task is the partition that read the document, before the tokens of its source that the task read earlier.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, before = encoder_of(tokenizer), TaskContext.get().partitionId(), {}
        for batch in (part for b in batches for part in by_bytes(b, batch_bytes)):
            starts, n, ids = [], [], []
            for s, x in zip(batch["source"].to_pylist(), encoder.encode(batch["text"].fill_null("")), strict=True):
                starts.append(before.get(s, 0))
                n.append(len(x) + 1)
                before[s] = starts[-1] + n[-1]
                ids.append(np.append(x, END).astype(encoder.kind).tobytes())
            columns = [batch["doc_id"], batch["source"], pa.array([task] * len(n), pa.int32()), pa.array(starts, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "source", "task", "before", "n_tokens", "ids"])

    return docs.select("doc_id", "text", F.col("source").cast("string")).mapInArrow(encoded, f"doc_id {kind}, source string, task int, before long, n_tokens long, ids binary")


class Schedule:
    """Deficit round-robin over queues with the given numbers of tokens and weights, in rounds of a window each.

    Each round credits every queue that still has tokens with its share of the window by weight; the queue sends the
    whole tokens it is owed and carries the rest over as its deficit. When a queue ends, its share goes to the others
    from the next round on. Credit grows by one step a round between the ends of queues, so what a queue has sent
    after r rounds is floor(weight * credit), known on any partition without running the rounds before: `ends` holds
    the round, the credit and the step from which each such phase starts. By default the weights are the tokens, so
    that all queues end together.
    """

    def __init__(self, tokens: list[int], weights: list[float] | None = None, window: int = WINDOW):
        self.tokens = np.array(tokens, np.int64)
        self.weights = np.maximum(self.tokens, 1).astype(float) if weights is None else np.array(weights, float)
        if len(self.weights) != len(self.tokens) or (self.weights <= 0).any():
            raise ValueError("every queue needs a weight above 0")
        self.window = max(window, LEAST * len(tokens))
        needs = self.tokens / self.weights
        order = np.argsort(needs, kind="stable")
        left = np.append(np.cumsum(self.weights[order][::-1])[::-1], 0.0)  # weight of the queues from each place of the order on
        rounds, credits, steps, at, credit = [], [], [], 0, 0.0
        place = int(np.searchsorted(needs[order], 0.0, "right"))
        while place < len(order):
            step = self.window / left[place]
            rounds.append(at)
            credits.append(credit)
            steps.append(step)
            more = max(1, int(np.ceil((needs[order[place]] - credit) / step)))
            while credit + more * step < needs[order[place]]:  # rounding
                more += 1
            at, credit = at + more, credit + more * step
            place = int(np.searchsorted(needs[order], credit, "right"))
        self.rounds = at
        self.phase, self.credit, self.step = np.array(rounds, np.int64), np.array(credits), np.array(steps)
        self._seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def credit_of(self, r: int) -> float:
        """The credit for each unit of weight after r rounds."""
        i = int(np.searchsorted(self.phase, r, "right")) - 1
        return self.credit[i] + (r - self.phase[i]) * self.step[i] if r < self.rounds else np.inf

    def sent(self, r: int) -> np.ndarray:
        """What each queue has sent before round r."""
        if r >= self.rounds:
            return self.tokens
        return np.minimum(np.floor(self.weights * self.credit_of(r)), self.tokens).astype(np.int64)

    def _sent(self, queue: int, r: int) -> int:
        n = int(self.tokens[queue])
        return n if r >= self.rounds else min(int(self.weights[queue] * self.credit_of(r)), n)

    def round_of(self, queue: int, x: int) -> int:
        """The round that sends a queue's token x."""
        need = (x + 1) / self.weights[queue]
        i = max(0, int(np.searchsorted(self.credit, need, "left")) - 1)
        r = max(0, min(self.rounds - 1, int(self.phase[i] + np.ceil((need - self.credit[i]) / self.step[i])) - 1))
        while self._sent(queue, r) > x:  # rounding
            r -= 1
        while self._sent(queue, r + 1) <= x:
            r += 1
        return r

    def turn(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        """What each queue has sent before round r, and before its turn in it all queues together."""
        if r not in self._seen:
            if len(self._seen) * len(self.tokens) * 16 > KEPT:
                self._seen.clear()
            now, then = self.sent(r), self.sent(r + 1)
            self._seen[r] = now, now.sum() + np.cumsum(then - now) - (then - now)
        return self._seen[r]

    def pieces(self, queue: int, start: int, n: int) -> Iterator[tuple[int, int, int]]:
        """Runs of n tokens from `start` on in a queue: (first of them, length, place among all tokens)."""
        x, end = start, start + n
        while x < end:
            r = self.round_of(queue, x)
            now, before = self.turn(r)
            most = min(end, self._sent(queue, r + 1))
            yield x - start, most - x, int(before[queue]) + x - int(now[queue])
            x = most


def pack(docs: DataFrame, tokenizer: str, weights: Mapping[str | None, float] | None = None, *, sequence: int = SEQUENCE, window: int = WINDOW) -> DataFrame:
    """One row for each piece of a document in a sequence: doc_id, source, start, length, ids_crc32, doc_tokens,
    sequence_id and offset, with the piece's ids.

    A document is its text's ids and END; a null text has END alone. The sources' documents queue in the order in
    which they are read. weights are the target proportions by source (1 where a source is not named); by default
    each source's share of all tokens. In each window of `window` tokens (LEAST for each source at least) every source
    that still has tokens has its share by weight, to the token, with what is left over carried on; a null source is a
    source of its own. Documents are cut at windows and sequences. Only the last sequence is shorter than `sequence`.
    Repeated rows are packed each; other columns are not read; an empty table gives no rows. tokenizer is a path that
    every executor has.

    Ids are written once; where a document stands follows from the sums of its source in earlier tasks, so nothing
    is sorted, and a source of any size is packed by as many tasks as read it. One row for each source, its number
    and weight, goes to every executor.
    """
    ids = saved(tokenised(docs, tokenizer), "token-ids")
    sums = saved(ids.groupBy("task", "source").agg(F.sum("n_tokens").alias("n")), "token-sums")
    # windows over one row for each source, and for each task of a source
    queue = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_first())) - 1
    queues = saved(sums.groupBy("source").agg(F.sum("n").alias("n")).withColumn("queue", queue), "token-queues")
    found = queues.orderBy("queue").collect()
    own = None if weights is None else [float(weights.get(r.source, 1.0)) for r in found]
    schedule = Schedule([r.n for r in found], own, window)
    before = Window.partitionBy("queue").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("s.source").eqNullSafe(F.col("q.source"))
    base = sums.alias("s").join(queues.select("source", "queue").alias("q"), same).select("task", "s.source", "queue", "n")
    base = base.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    both = (F.col("i.task") == F.col("b.task")) & F.col("i.source").eqNullSafe(F.col("b.source"))
    placed = ids.alias("i").join(base.alias("b"), both).select("doc_id", "i.source", "queue", (F.col("base") + F.col("before")).alias("at"), "ids")
    kind = dict(docs.dtypes)["doc_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        kept = encoder_of(tokenizer).kind
        for batch in batches:
            rows, which = [], []
            for i, (q, at, raw) in enumerate(zip(batch["queue"].to_pylist(), batch["at"].to_pylist(), batch["ids"], strict=True)):
                x = np.frombuffer(raw.as_py(), kept).astype("<u4")
                for first, n, place in schedule.pieces(q, at, len(x)):
                    while n:
                        k = min(n, sequence - place % sequence)
                        own = x[first : first + k].tobytes()
                        rows.append((first, k, zlib.crc32(own), len(x), place // sequence, place % sequence, own))
                        which.append(i)
                        first, n, place = first + k, n - k, place + k
            if not rows:
                continue
            columns = list(zip(*rows, strict=True))
            index = pa.array(which, pa.int64())
            arrays = [batch["doc_id"].take(index), batch["source"].take(index), *(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return placed.mapInArrow(cut, f"doc_id {kind}, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
