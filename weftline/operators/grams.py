"""Exact search through an index of trigrams: posting lists tell which texts can match, and only these are read closely."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants, _parser

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.plans.tables import written

#: Texts of a block, one bit each in its posting lists.
BLOCK = 256
WORDS = BLOCK // 64


@dataclass(frozen=True)
class Index:
    """texts (block, slot, key, text) and postings (gram, block, words), sorted by gram so that a search reads few row groups.

    A gram is three bytes of UTF-8 as a number; bit i of the words is the text in slot i.
    """

    texts: DataFrame
    postings: DataFrame


def grams_of(raw: bytes) -> np.ndarray:
    """The different trigrams of some bytes, in order."""
    x = np.frombuffer(raw, np.uint8).astype(np.int32)
    return np.unique((x[:-2] << 16) | (x[1:-1] << 8) | x[2:]) if len(x) > 2 else np.zeros(0, np.int32)


def build_index(docs: DataFrame, key: str, column: str) -> Index:
    """The index of a column's texts. Null texts match nothing and are left out; repeated rows stay."""
    kind = dict(docs.dtypes)[key]

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            place = np.arange(n, n + batch.num_rows)
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array((task << 32) + place // BLOCK), pa.array(place % BLOCK, pa.int32()), *batch.columns], ["block", "slot", "key", "text"])

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # a block may stand in two batches; then its lists come in two rows
            blocks, slots = batch["block"].to_numpy(), batch["slot"].to_numpy()
            raw = batch["text"].cast(pa.large_binary())
            for block in np.unique(blocks):
                own = np.flatnonzero(blocks == block)
                found = [grams_of(raw[int(i)].as_py()) for i in own]
                grams, at = np.unique(np.concatenate(found), return_inverse=True)
                words = np.zeros((len(grams), WORDS), np.uint64)
                slot = np.repeat(slots[own], [len(g) for g in found])
                np.bitwise_or.at(words, (at, slot // 64), np.uint64(1) << (slot % 64).astype(np.uint64))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(words.view(np.int64).ravel()), WORDS).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(grams.astype(np.int32)), pa.array(np.full(len(grams), block)), lists], ["gram", "block", "words"])

    rows = docs.where(F.col(column).isNotNull()).select(F.col(key).alias("key"), F.col(column).cast("string").alias("text"))
    texts = written(rows.mapInArrow(numbered, f"block long, slot int, key {kind}, text string"))
    lists = texts.select("block", "slot", "text").mapInArrow(posted, "gram int, block long, words array<long>")
    return Index(texts, written(lists.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block")))


def _runs(parsed: object) -> list[str]:
    """Strings that stand in every match, by the parts of a pattern that are not optional."""
    out, now = [], ""
    for op, value in parsed:
        if op is _constants.LITERAL:
            now += chr(value)
            continue
        inner: list[str] = []
        if op is _constants.SUBPATTERN and not value[1] and not value[2]:
            inner = _runs(value[3])
        elif op in (_constants.MAX_REPEAT, _constants.MIN_REPEAT) and value[0] > 0:
            inner = _runs(value[2])
        out += [now, *inner]
        now = ""
    return [x for x in [*out, now] if x]


def needed(literal: str | None, regex: str | None) -> list[int]:
    """Trigrams that every match holds; none if the pattern names no three characters in a row that it can't do without."""
    runs = [literal] if literal is not None else []
    if regex is not None:
        try:
            parsed = _parser.parse(regex)
            octal = "\\0" in regex  # the two dialects read its digits differently
            runs = [] if octal or parsed.state.flags & re.IGNORECASE else _runs(parsed)
        except (re.error, OverflowError):  # a pattern that only the other dialect knows
            runs = []
    return sorted({int(g) for x in runs for g in grams_of(x.encode())})


def candidates(index: Index, grams: list[int]) -> DataFrame:
    """(block, slot) of the texts that hold all of the trigrams."""
    lists = index.postings.where(F.col("gram").isin(grams))
    both = [F.bit_or(F.col("words")[i]).alias(f"w{i}") for i in range(WORDS)]
    each = lists.groupBy("block", "gram").agg(*both)  # the rows of a block that stood in two batches
    met = each.groupBy("block").agg(F.count(F.lit(1)).alias("n"), *[F.bit_and(f"w{i}").alias(f"w{i}") for i in range(WORDS)]).where(F.col("n") == len(grams))
    words = F.posexplode(F.array(*[F.col(f"w{i}") for i in range(WORDS)])).alias("word", "bits")
    slots = met.select("block", words).where("bits <> 0").select("block", "word", "bits", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
    return slots.where(F.getbit("bits", F.col("bit")) == 1).select("block", (F.col("word") * 64 + F.col("bit")).alias("slot"))


def search(index: Index, literal: str | None = None, regex: str | None = None) -> DataFrame:
    """(key) of the texts that hold a literal, or match a regular expression; the same rows as a scan of all texts.

    Only texts with all trigrams that a match needs are tried. An empty or short literal, and a pattern that needs
    nothing, try every text.
    """
    grams = needed(literal, regex)
    texts = index.texts.join(candidates(index, grams), ["block", "slot"]) if grams else index.texts
    return texts.where(F.contains("text", F.lit(literal)) if regex is None else F.col("text").rlike(regex)).select("key")
