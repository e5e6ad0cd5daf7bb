"""Log probabilities of texts by online logistic context mixing over a corpus memory."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import token_bits
from weftline.llm.shared import id_key, saved
from weftline.llm.wordhash import by_bytes, mix

#: Letters before a bit that each predictor hashes, and the bits of its table's size: a bound for what is broadcast.
ORDERS, TABLE_BITS = (1, 2, 3, 5), (16, 18, 20, 20)
SEGMENT = 1 << 16
GATES = 8 * (len(ORDERS) + 1)
#: Smoothing of a predictor's counts, and most of a log odds.
PSEUDO, MOST = 0.3, 8.0
#: Learning rate, letters of a learning step, letters that are spelled or counted at a time.
RATE, LEARN, STEP = 0.4, 5_000, 50_000
#: Bytes of text that one block holds.
BLOCK = 8 << 20
#: Tokens of a block that are counted at a time, and that are scored at a time, or one longer document.
RUN, SCORED = 1 << 20, 200_000
#: Segments of tables on their way to the driver.
SEGMENTS = "k int, segment int, zeros binary, ones binary"


@dataclass(frozen=True)
class Letters:
    """The bytes of words, each with a space behind it, and for each byte the hashes of what stands before it in its word."""

    byte: np.ndarray
    word: np.ndarray
    context: list[np.ndarray]


def letters(words: pa.Array, most: int) -> Iterator[Letters]:
    """The letters of words in parts of `most`; a part may end inside a word, and the next still sees what stands before it."""
    raw = words.cast(pa.large_binary())
    _, offsets, data = raw.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(raw) + 1, raw.offset * 8) if len(raw) else np.zeros(1, np.int64)
    source = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    size = np.diff(bounds) + 1
    end = np.cumsum(size)
    for begin in range(0, int(size.sum()), most):
        lead = min(begin, max(ORDERS))
        at = np.arange(begin - lead, min(begin + most, end[-1]))
        word = np.searchsorted(end, at, "right")
        inner = at < end[word] - 1
        byte = np.full(len(at), 32, np.uint8)
        byte[inner] = source[(at - word)[inner]]  # each word before has added one space
        place = at - (end - size)[word]
        context, h = [], np.zeros(len(at), np.uint64)
        for back in range(1, max(ORDERS) + 1):
            before = np.zeros(len(at), np.uint64)
            before[back:] = byte[:-back]
            before[place < back] = 0  # before the word's first letter
            h = h * np.uint64(0x100000001B3) + before + np.uint64(1)
            if back in ORDERS:
                context.append(mix(h + np.uint64(back))[lead:])
        yield Letters(byte[lead:], word[lead:], context)


def slots(part: Letters, bit: int) -> list[np.ndarray]:
    """The slot of each predictor for one bit of each letter, highest bits first."""
    node = (np.uint64(1 << bit) | (part.byte >> np.uint8(8 - bit)).astype(np.uint64)) if bit else np.uint64(1)
    return [(((h ^ (node * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - size)).astype(np.int64) for h, size in zip(part.context, TABLE_BITS, strict=True)]


@dataclass
class Predictors:
    """Counts of zeros and ones in each predictor's slots, and the weights that mix them, by gate."""

    zeros: list[np.ndarray]
    ones: list[np.ndarray]
    weights: np.ndarray

    def bits(self, part: Letters, itself: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each of a letter's bits: the log odds of every predictor, the gate and the bit.

        The gate is the bit's place and the number of predictors that have seen the context. If the words stand in
        the counts themselves, their own part is taken off, so that the weights are learnt as for unknown words.
        """
        for bit in range(8):
            value = (part.byte >> np.uint8(7 - bit)) & np.uint8(1)
            odds, seen = np.empty((len(ORDERS) + 1, len(value)), np.float32), np.zeros(len(value), np.int64)
            for k, at in enumerate(slots(part, bit)):
                zero, one = self.zeros[k][at], self.ones[k][at]
                if itself:
                    zero, one = np.maximum(zero - (value == 0), 0), np.maximum(one - value, 0)
                odds[k] = np.clip(np.log((one + PSEUDO) / (zero + PSEUDO)), -MOST, MOST)
                seen += zero + one > 0
            odds[-1] = 0.3  # a bias
            yield odds, bit * (len(ORDERS) + 1) + seen, value

    def mixed(self, odds: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.weights.T[:, gate] * odds).sum(0), -20, 20)))


def _first_weights() -> np.ndarray:
    weights = np.full((GATES, len(ORDERS) + 1), 0.35)
    weights[:, -1] = 0
    return weights


def _packed(counts: np.ndarray) -> bytes:
    """Counts by byte planes, compressed: most planes are zero."""
    return pa.compress(np.ascontiguousarray(counts.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, SEGMENT * 8, codec="zstd", asbytes=True), np.uint8).reshape(8, SEGMENT)
    return np.ascontiguousarray(planes.T).view("<i8").reshape(-1)


def _cut_tables(tables: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The segments of tables that hold a count."""
    for k, table in enumerate(tables):
        cut = [(s, *table[:, s : s + SEGMENT]) for s in range(0, table.shape[1], SEGMENT)]
        cut = [(s // SEGMENT, _packed(z), _packed(o)) for s, z, o in cut if z.any() or o.any()]
        if cut:
            seg, z, o = zip(*cut, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(seg), pa.int32()), pa.array(seg, pa.int32()), pa.array(z, pa.binary()), pa.array(o, pa.binary())], ["k", "segment", "zeros", "ones"])


def _summed(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, SEGMENT), np.int64)
    for t in tables:
        for z, o in zip(t["zeros"], t["ones"], strict=True):
            total[0] += _unpacked(z.as_py())
            total[1] += _unpacked(o.as_py())
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([_packed(total[0])], pa.binary()), pa.array([_packed(total[1])], pa.binary())], ["k", "segment", "zeros", "ones"])


def _segments(lexicon: DataFrame) -> DataFrame:
    """Counts of each predictor's slots over all known words, in segments of the tables."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros((2, 1 << b), np.int64) for b in TABLE_BITS]
        for batch in batches:
            for part in letters(batch["word"], STEP):
                for bit in range(8):
                    value = (part.byte >> np.uint8(7 - bit)) & np.uint8(1)
                    for table, slot in zip(tables, slots(part, bit), strict=True):
                        np.add.at(table.reshape(-1), slot + value * np.int64(table.shape[1]), 1)
        yield from _cut_tables(tables)

    return lexicon.where("c > 0").select("word").mapInArrow(counted, SEGMENTS).groupBy("k", "segment").applyInArrow(_summed, SEGMENTS)


def _predictors(lexicon: DataFrame) -> Predictors:
    """Counts over all known words, then weights learnt online over all known words.

    Each task starts from the same weights and steps through its words; the tasks' weights are averaged by the
    letters they saw. Both come to the driver: tables of a fixed size, and one small row for each task.
    """
    zeros, ones = ([np.zeros(1 << b, np.float32) for b in TABLE_BITS] for _ in range(2))
    for r in _segments(lexicon).collect():
        at = slice(r.segment * SEGMENT, (r.segment + 1) * SEGMENT)
        zeros[r.k][at], ones[r.k][at] = _unpacked(r.zeros), _unpacked(r.ones)
    start = Predictors(zeros, ones, _first_weights())
    sent = lexicon.sparkSession.sparkContext.broadcast(start)

    def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = Predictors(sent.value.zeros, sent.value.ones, sent.value.weights.copy()), 0
        for batch in batches:
            for part in letters(batch["word"], LEARN):
                for odds, gate, value in own.bits(part, itself=True):
                    wrong = value - own.mixed(odds, gate)
                    seen = np.bincount(gate, minlength=GATES)
                    step = np.stack([np.bincount(gate, wrong * x, GATES) for x in odds], 1)
                    own.weights += RATE * step / np.maximum(seen, 100)[:, None]
                n += len(part.byte)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([own.weights.tobytes()], pa.binary())], ["n", "weights"])

    total, weights = 0, np.zeros_like(start.weights)
    for r in lexicon.where("c > 0").select("word").mapInArrow(learnt, "n long, weights binary").collect():
        total, weights = total + r.n, weights + r.n * np.frombuffer(r.weights).reshape(weights.shape)
    return Predictors(zeros, ones, weights / total if total else start.weights)


def spelled(words: pa.Array, model: Predictors) -> np.ndarray:
    """The log10 probability of each word's bits, with the space behind it."""
    out = np.zeros(len(words))
    for part in letters(words, STEP):
        total = np.zeros(len(part.byte))
        for odds, gate, value in model.bits(part, itself=False):
            p = model.mixed(odds, gate)
            total += np.log10(np.where(value == 1, p, 1 - p))
        first, last = part.word[0], part.word[-1]
        out[first : last + 1] += np.bincount(part.word - first, total)
    return out


def _running_words(tokens: bytes, lengths: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each token of a block, ends included: its document, its place there and the hash of its word."""
    token = np.insert(np.frombuffer(tokens, "<u4").astype(np.int64), np.cumsum(lengths), 0)
    doc = np.repeat(np.arange(len(lengths)), lengths + 1)
    return doc, np.arange(len(doc)) - np.searchsorted(doc, doc), words[token]


def _context_tables(blocks: DataFrame) -> list[np.ndarray]:
    """Counts of the bits of all training text under each hashed context, (2, slots) each: tables of a fixed size, to the driver."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros((2, 1 << b), np.int64) for b in token_bits.TABLE_BITS]
        for batch in batches:
            for i in range(batch.num_rows):
                words = np.array([zlib.crc32(w.encode()) for w in batch["words"][i].as_py()], np.uint32)
                held, lengths = (batch[name][i].values.to_numpy(zero_copy_only=False) for name in ("held", "lengths"))
                doc, place, word = _running_words(batch["tokens"][i].as_py(), lengths, words)
                for at in range(0, len(doc), RUN):
                    lead = max(0, at - max(token_bits.WORDS_BEFORE))
                    run = slice(lead, at + RUN)
                    counts = ~held[doc[run]]
                    counts[: at - lead] = False
                    token_bits.count_bits(tables, word[run], place[run], counts)
        yield from _cut_tables(tables)

    tables = [np.zeros((2, 1 << b), np.int64) for b in token_bits.TABLE_BITS]
    for r in blocks.select("held", "lengths", "tokens", "words").mapInArrow(counted, SEGMENTS).groupBy("k", "segment").applyInArrow(_summed, SEGMENTS).collect():
        tables[r.k][:, r.segment * SEGMENT : (r.segment + 1) * SEGMENT] = _unpacked(r.zeros), _unpacked(r.ones)
    return tables


def _blocks(docs: DataFrame) -> DataFrame:
    """Documents in blocks: their tokens as numbers of the block's words, and the words' counts in training documents."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in (part for b in batches for part in by_bytes(b, BLOCK)):
            texts, rows = batch["text"].fill_null(""), batch.num_rows
            split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
            parts = pc.ascii_lower(split.flatten()).dictionary_encode()
            words, which = parts.dictionary, parts.indices.to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(rows), np.diff(split.offsets.to_numpy()))
            full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
            number_of = np.cumsum(full)  # 0 is the end
            keep = full[which]
            owner, which = owner[keep], number_of[which[keep]]
            held = batch["held"].to_numpy(zero_copy_only=False)
            n = np.bincount(which, (~held)[owner], int(full.sum()) + 1).astype(np.int64)
            n[0] = (~held).sum()
            lengths = np.bincount(owner, minlength=rows)
            texts_of = pa.concat_arrays([pa.array([""], pa.large_string()), words.filter(pa.array(full))]).cast(pa.string())
            row = [pa.array([number], pa.int64()), pa.ListArray.from_arrays([0, rows], batch["doc_id"]), pa.array([held.tolist()], pa.list_(pa.bool_())), pa.array([lengths.tolist()], pa.list_(pa.int64())), pa.array([pc.binary_length(texts).to_pylist()], pa.list_(pa.int64())), pa.array([which.astype("<u4").tobytes()], pa.binary()), pa.ListArray.from_arrays([0, len(texts_of)], texts_of), pa.ListArray.from_arrays([0, len(n)], pa.array(n))]
            yield pa.RecordBatch.from_arrays(row, ["block", "doc_ids", "held", "lengths", "sizes", "tokens", "words", "counts"])
            number += 1

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"block long, doc_ids array<{kind}>, held array<boolean>, lengths array<long>, sizes array<long>, tokens binary, words array<string>, counts array<long>"
    held = (F.crc32(id_key(F.col("doc_id")).cast("binary")) % 10 == 0).alias("held")
    return docs.select("doc_id", "text", held).mapInArrow(cut, schema)


def score_documents(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes and
    bits_per_byte.

    Tokens are the words, A-Z lower-cased, and one end. Documents whose CRC-32 of doc_id, modulo 10, is not 0 train
    the model. A null text has the end alone, a null doc_id counts as an empty one; repeated rows count each; other
    columns are not read; an empty table gives no rows. score is the log10 probability of the tokens, bits_per_byte
    the same in bits over the text's UTF-8 bytes and one.

    The corpus memory is the count of every training token, exact, and is joined to each block's words by a shuffle;
    tables of hashed contexts of one and two words count the bits of all training text. Along a document, gated
    logistic weights mix these with the document's own words and the next foreseen word, bit by bit, and adapt (see
    token_bits). Words without a training count are spelled: predictors of hashed letters, counted over all known
    words, are mixed the same way.
    """
    blocks = saved(_blocks(docs), "lm-blocks", wide=True)
    vocabulary = blocks.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("pos", "w")).select("block", "pos", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    lexicon = saved(vocabulary.groupBy("word").agg(F.sum("n").alias("c")), "lm-lexicon")
    code = F.crc32(F.col("word").cast("binary"))
    by_code, kinds, once = np.zeros(token_bits.NODES, np.int64), 0, 0
    for r in lexicon.groupBy((code % token_bits.NODES).alias("code")).agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("kinds"), F.count(F.when(F.col("c") == 1, 1)).alias("once")).collect():
        by_code[r.code], kinds, once = r.n, kinds + r.kinds, once + r.once
    tokens = int(by_code.sum())
    model = _predictors(lexicon), token_bits.Corpus.of(_context_tables(blocks), by_code, once)
    sent = lexicon.sparkSession.sparkContext.broadcast(model)
    stats = vocabulary.select("block", "pos", "word").join(lexicon, "word").select(F.col("block").alias("of"), "pos", "c", code.alias("hash"), F.when(F.col("c") == 0, F.col("word")).alias("unknown"))
    kind = dict(docs.dtypes)["doc_id"]

    def score(block: pa.Table, words: pa.Table) -> pa.Table:
        order = np.argsort(words["pos"].to_numpy())
        c, crc = words["c"].to_numpy()[order], words["hash"].to_numpy()[order].astype(np.uint32)
        letters_model, corpus = sent.value
        spelling = np.zeros(len(c))
        spelling[c == 0] = spelled(pa.concat_arrays(words["unknown"].take(pa.array(order[c == 0])).cast(pa.large_string()).chunks or [pa.array([], pa.large_string())]), letters_model)
        row = {name: block[name][0].values for name in ("doc_ids", "held", "lengths", "sizes")}
        lengths = row["lengths"].to_numpy()
        token = np.insert(np.frombuffer(block["tokens"][0].as_py(), "<u4").astype(np.int64), np.cumsum(lengths), 0)
        doc = np.repeat(np.arange(len(lengths)), lengths + 1)
        base = np.log10((c + 0.1) / (tokens + 0.1 * (kinds + 1)))
        # some documents at a time
        cuts = np.searchsorted(doc, np.append(np.unique(doc[::SCORED]), len(lengths))) if len(doc) else [0]
        parts = [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
        mixed = np.concatenate([token_bits.token_scores(doc[x], token[x], crc, c, spelling, corpus) for x in parts])
        add = lambda x: np.bincount(doc, x, len(lengths))
        total, size = add(mixed), row["sizes"].to_numpy() + 1
        return pa.table(
            {
                "doc_id": row["doc_ids"],
                "held_out": row["held"],
                "n_tokens": lengths + 1,
                "n_known": add((c > 0)[token]).astype(np.int64),
                "train_tokens": np.full(len(lengths), tokens, np.int64),
                "base_score": add(base[token]),
                "score": total,
                "n_bytes": size - 1,
                "bits_per_byte": -total / np.log10(2) / size,
            }
        )

    out = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    return blocks.select("block", "doc_ids", "held", "lengths", "sizes", "tokens").groupBy("block").cogroup(stats.groupBy("of")).applyInArrow(score, out)
