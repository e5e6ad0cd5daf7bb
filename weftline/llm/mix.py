"""Weighted fair queueing of sources to target weights, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from weftline.llm.shared import hash_bucket, id_key, saved, words

#: Times that a document may be taken.
EPOCHS = 3
#: Words that a queue sends at a time; long documents are sent in parts, so that targets are met to a part.
PACKET = 64
#: Ranges of finish times that are summed at a time around the cut, and parts that are then summed in order.
RANGES, FEW = 256, 5_000
#: Copies of one row that one task numbers at most.
BLOCK = 10_000


def source_targets(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), epochs: int = EPOCHS) -> DataFrame:
    """One row for each source of (source, size): source_rank, source_size, weight and target.

    Sources by code point, null last, get the weights in turn. target is min(weight * t, epochs * source_size) with
    the one t at which the targets' sum is the sum of all sizes. The windows without a partition see one row for
    each source.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy("fill", "source_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("source_rank") - 1) % len(weights) + 1).cast("int"))
    s = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    s = s.withColumn("source_rank", F.row_number().over(by_name)).withColumn("weight", weight)
    s = s.withColumn("limit", (F.col("source_size") * epochs).cast("double")).withColumn("fill", F.col("limit") / F.col("weight"))
    # sources that fill up first hand what is left of the total to the others by weight
    filled = F.coalesce(F.sum("limit").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", (F.sum(F.col("source_size").cast("double")).over(everything) - filled) / open_weight)
    s = s.withColumn("t", F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "source_rank", "level"))).over(everything)["level"])
    s = s.withColumn("target", F.least(F.col("weight") * F.col("t"), F.col("limit")))
    return s.select("source", "source_rank", "source_size", "weight", "target")


def _queues(docs: DataFrame, weights: Sequence[float], epochs: int, seed: str, content: Column | None = None) -> DataFrame:
    """A row for each doc_id, source, size and content: copies, words of these, and start, the words before them in the queue.

    A queue is summed in 4096 hash buckets first, so that no task holds a whole source.
    """
    own = F.lit(0).cast("long") if content is None else content
    sized = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), own.alias("content"))
    rows = saved(sized.groupBy("doc_id", "source", "size", "content").agg(F.count(F.lit(1)).alias("copies")), "mix-rows")
    targets = saved(source_targets(rows.select("source", (F.col("size") * F.col("copies")).alias("size")), weights, epochs), "mix-targets")
    key = F.concat(F.lit(f"{seed}:"), id_key(F.col("doc_id")))
    rows = rows.withColumns({"bucket": hash_bucket(key), "shuffled": F.md5(key), "words": F.col("size") * F.col("copies")})

    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("source", "bucket").agg(F.sum("words").alias("in_bucket"))
    starts = starts.withColumn("bucket_start", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)))
    starts = starts.alias("a").join(targets.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))
    starts = starts.select("a.source", "a.bucket", "bucket_start", "source_rank", "source_size", "weight", "target")

    order = Window.partitionBy("source", "bucket").orderBy("shuffled", "doc_id", "size", "content").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("in_bucket", F.coalesce(F.sum("words").over(order), F.lit(0)))
    both = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.bucket") == F.col("b.bucket"))
    rows = rows.alias("a").join(starts.alias("b"), both)
    rows = rows.select("doc_id", "a.source", "size", "content", "copies", "words", (F.col("in_bucket") + F.col("bucket_start")).alias("start"), "source_rank", "source_size", "weight", "target")
    return saved(rows, "mix-queues")


def _served(queues: DataFrame, epochs: int) -> DataFrame:
    """(source_rank, served): the words of each source that lie before the global cut.

    Every part of PACKET words, in every pass, gets its virtual finish time: the source's words up to its end, all
    passes together, divided by the weight. The parts are range-sorted by it (equal times by source and place), their
    sizes are summed by partition, then by ever smaller ranges of the one partition where the total is spent, and the
    part there is cut. Parts with equal times are of different sources.
    """
    first = F.explode(F.expr(f"sequence(0L, words - 1, {PACKET}L)")).alias("first")
    parts = queues.where("words > 0").select("source_rank", "source_size", "weight", "start", "words", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    parts = parts.select("source_rank", "weight", "words", (F.col("epoch") * F.col("source_size") + F.col("start")).alias("start"), first)
    size = F.least(F.lit(PACKET), F.col("words") - F.col("first")).cast("int")
    at = F.col("start") + F.col("first")
    parts = parts.select("source_rank", at.alias("at"), size.alias("n"), ((at + size) / F.col("weight")).alias("finish"))
    order = ["finish", "source_rank", "at"]
    ranged = saved(parts.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "mix-ranged")
    sums = ranged.groupBy("part").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = queues.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    hit = sums.select("part", "n", before.alias("before")).where((F.col("before") < total) & (F.col("before") + F.col("n") >= total)).first()
    if hit is None:  # no words at all
        return queues.select("source_rank", F.lit(0).cast("long").alias("served")).distinct()
    own, before = ranged.where(F.col("part") == hit.part), hit.before
    while True:  # sums over ever smaller ranges of finish times, until few parts are left
        lo, hi, n = own.agg(F.min("finish"), F.max("finish"), F.count(F.lit(1))).first()
        if n <= FEW or lo == hi:
            break
        step = F.least(F.floor((F.col("finish") - lo) / (hi - lo) * RANGES), F.lit(RANGES - 1))
        for r in own.groupBy(step.alias("step")).agg(F.sum("n").alias("n"), F.min("finish").alias("lo"), F.max("finish").alias("hi")).orderBy("step").collect():
            if before + r.n >= total:
                own = own.where(F.col("finish").between(r.lo, r.hi))
                break
            before += r.n
    own = own.select(*order, "n", (F.sum("n").over(Window.orderBy(*order)) + before).alias("upto"))
    cut = own.where(F.col("upto") >= total).orderBy(*order).first()
    this, last = F.struct(*order), F.struct(F.lit(cut.finish).alias("finish"), F.lit(cut.source_rank).alias("source_rank"), F.lit(cut["at"]).cast("long").alias("at"))
    taken = F.when(this < last, F.col("n")).when(this == last, F.lit(cut.n - (cut.upto - total)).cast("int")).otherwise(0)
    return saved(ranged.groupBy("source_rank").agg(F.sum(taken).cast("long").alias("served")), "mix-served")


def _within(start: Column, size: Column, epochs: int) -> list[Column]:
    """The words of a stretch of the queue that were served, in each pass."""
    return [F.greatest(F.lit(0), F.least(size, F.col("served") - start - F.col("source_size") * epoch)) for epoch in range(epochs)]


def mix_plan(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), epochs: int = EPOCHS, *, seed: str = "mix") -> DataFrame:
    """One row for each document: doc_id, size, source, source_size, target, taken and virtual_finish.

    Each source queues its documents in the order of a hash of doc_id, `epochs` times over. A document's virtual
    finish time is the source's words up to its end, divided by the source's weight. All queues together, in order of
    virtual finish time and PACKET words at a time, are cut where the total of all sizes is spent; taken sums the
    words of a document before that cut, over all passes. virtual_finish is that of the first pass.

    A null text has size 0, a null source is a source of its own, a null doc_id has the empty key. Rows with equal
    doc_id, source and size stand side by side in the queue and share its words in one order or the other. Other
    columns are not read; an empty table gives no rows. Reruns agree, whatever the partitions.
    """
    queues = _queues(docs, weights, epochs, seed)
    rows = queues.join(_served(queues, epochs), "source_rank", "left").fillna(0, ["served"])
    rows = rows.withColumn("block", F.explode(F.expr(f"sequence(0L, (copies - 1) div {BLOCK})")))
    rows = rows.withColumn("copy", F.explode(F.expr(f"sequence(block * {BLOCK}, least(copies, (block + 1) * {BLOCK}) - 1)")))
    start = F.col("start") + F.col("copy") * F.col("size")
    taken = sum(_within(start, F.col("size"), epochs), F.lit(0)).cast("long")
    return rows.select("doc_id", "size", "source", "source_size", "target", taken.alias("taken"), ((start + F.col("size")) / F.col("weight")).alias("virtual_finish"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), epochs: int = EPOCHS, *, seed: str = "mix") -> DataFrame:
    """The documents that the mix takes, each as often as it is taken, with the columns of docs.

    Texts stay whole: a document taken in part counts as one more copy if at least half of its words are taken. Null,
    empty and blank texts have no words, are in no proportion and go. Rows that are equal in all columns are one
    document with so many copies; null sources and doc_ids are handled as in mix_plan; columns of any name are
    carried (maps and variants don't tell rows apart). An empty table gives no rows.
    """
    plain = [F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, (MapType, VariantType))]
    content = F.xxhash64(*plain)
    queues = _queues(docs, weights, epochs, seed, content).where("size > 0")
    queues = queues.join(_served(queues, epochs), "source_rank", "left").fillna(0, ["served"])
    # only the last of the words served ends within a document, so at most one of the passes has a rest
    times = sum((F.floor(x / F.col("size") + 0.5) for x in _within(F.col("start"), F.col("words"), epochs)), F.lit(0))
    queues = queues.select(F.concat_ws(":", id_key(F.col("doc_id")), "size", "content").alias("__key"), times.cast("long").alias("__times")).where("__times > 0")
    size = F.size(words(F.col("text"))).cast("long")
    rows = docs.withColumn("__key", F.concat_ws(":", id_key(F.col("doc_id")), size, content)).dropDuplicates(["__key"]).join(saved(queues, "mix-times"), "__key")
    rows = rows.withColumn("__block", F.explode(F.expr(f"sequence(0L, (__times - 1) div {BLOCK})")))
    rows = rows.withColumn("__time", F.explode(F.expr(f"sequence(__block * {BLOCK}, least(__times, (__block + 1) * {BLOCK}) - 1)")))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
