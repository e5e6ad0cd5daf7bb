"""Quality rules with risk-controlled cutoffs, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.shared import saved, words

#: Share of good documents that all rules together may reject in a stratum, and the chance that this fails anywhere.
RISK, DOUBT = 0.01, 0.05
SYMBOLS = "#*$%&|<>"
FEATURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed"]

# Cutoffs of each rule from the most lenient to the strictest; a rule rejects what is above its cutoff.
CUTOFFS: dict[str, list[float]] = {
    "symbols": [0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05, 0.02],
    "repeats": [0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15],
    "duplicate_lines": [0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2],
}


def text_features(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; a null text counts as empty.

    Three-word windows are compared by a 64-bit hash, and sorted with their places where any repeats, so a text of n
    words takes n log n steps. The features of a text need no other row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumn("__words", words(F.col("text"))).withColumn("n_words", F.size("__words").cast("long"))
    d = d.withColumn("__hashes", F.expr("case when n_words < 3 then cast(array() as array<bigint>) else transform(sequence(0, cast(n_words as int) - 3), i -> xxhash64(__words[i], __words[i + 1], __words[i + 2])) end"))
    # most texts repeat no window, and need no sort
    d = d.withColumn("__windows", F.expr("case when size(array_distinct(__hashes)) = size(__hashes) then array() else sort_array(transform(__hashes, (h, i) -> struct(h as h, i as i))) end"))
    # places of windows that stand twice or more, in order
    d = d.withColumn("__found", F.expr("sort_array(transform(filter(__windows, (x, i) -> (i > 0 and get(__windows, i - 1).h = x.h) or get(__windows, i + 1).h <=> x.h), x -> x.i))"))
    covered = "aggregate(__found, struct(-3 as last, 0L as n), (a, i) -> struct(i as last, a.n + least(3, i - a.last) as n), a -> a.n)"
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")
    d = d.withColumn("__lines", lines)
    d = d.withColumns(
        {
            "word_chars": F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": F.expr(covered),
        }
    )
    d = d.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    return d.drop("__words", "__hashes", "__windows", "__found", "__lines")


def scores() -> dict[str, Column]:
    """What each rule compares with its cutoff."""
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {"symbols": ratio("n_symbols", "word_chars"), "repeats": ratio("n_repeat_words", "n_words"), "duplicate_lines": ratio("n_dup_lines", "n_lines")}


def binomial_tail(k: str, n: str, p: str) -> Column:
    """P(X <= k) for X binomial with n draws of chance p, summed over logarithms of its terms."""
    step = f"i -> ln({n} - i + 1) - ln(i) + ln({p}) - ln(1 - {p})"
    add = "(a, x) -> struct(a.term + x as term, case when a.term + x > a.total then a.term + x + ln(1 + exp(a.total - a.term - x)) else a.total + ln(1 + exp(a.term + x - a.total)) end as total)"
    return F.expr(f"aggregate(case when {k} < 1 then array() else transform(sequence(1L, cast({k} as bigint)), {step}) end, struct({n} * ln(1 - {p}) as term, {n} * ln(1 - {p}) as total), {add}, a -> exp(a.total))")


def risk_controlled(labelled: DataFrame, stratum: str, cutoffs: Mapping[str, Sequence[float]] = CUTOFFS, risk: float = RISK, doubt: float = DOUBT) -> DataFrame:
    """(rule, stratum, cutoff, n_good, n_rejected): the strictest cutoff of each rule that is shown to be safe.

    labelled has `stratum`, `quality` (1 is good) and the columns of text_features. A cutoff is tested on the good
    documents of its stratum that the base rules keep: it is safe if as few rejections as these, or fewer, have a
    chance of at most the level where the true share is `risk` divided by the rules, by the exact binomial
    distribution. Cutoffs are tested from the most lenient on until one fails, which costs no level, since a stricter
    one never rejects less; strata and rules share `doubt` equally (Bonferroni). So with a chance of at least
    1 - doubt, all rules together reject at most `risk` of the good documents in every stratum. A stratum with too
    few labels gets no cutoff and loses nothing.
    """
    good = labelled.where("quality = 1 and not base_failed")
    pairs = [F.struct(F.lit(rule).alias("rule"), F.col(f"__{rule}").alias("score")) for rule in cutoffs]
    scored = good.withColumns({f"__{rule}": scores()[rule] for rule in cutoffs}).select(F.col(stratum).alias("stratum"), F.explode(F.array(*pairs)).alias("r")).select("stratum", "r.*")
    steps = F.create_map(*[x for rule, c in cutoffs.items() for x in (F.lit(rule), F.array(*[F.lit(float(v)) for v in c]))])
    # how many good documents each cutoff rejects: one row for each stratum, rule and step
    longest = max(map(len, cutoffs.values()))
    above = [F.count(F.when(F.col("score") > F.get(steps[F.col("rule")], F.lit(i)), 1)).alias(f"k{i}") for i in range(longest)]
    counted = scored.groupBy("stratum", "rule").agg(F.count(F.lit(1)).alias("n_good"), *above)
    tests = counted.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(longest - 1))))
    tests = tests.withColumn("n_rejected", F.get(F.array(*[F.col(f"k{i}") for i in range(longest)]), F.col("step")))
    tests = tests.withColumn("cutoff", F.get(steps[F.col("rule")], F.col("step"))).where("cutoff is not null")
    strata = F.count_distinct("stratum") + F.max(F.col("stratum").isNull().cast("int"))
    level = counted.agg((F.lit(float(doubt)) / (len(cutoffs) * strata)).alias("level"))
    tests = tests.crossJoin(F.broadcast(level)).withColumn("p", F.lit(float(risk) / len(cutoffs)))
    # more rejections than expected can't pass, and need no sum
    safe = F.when(F.col("n_rejected") > F.col("n_good") * F.col("p"), F.lit(False)).otherwise(binomial_tail("n_rejected", "n_good", "p") <= F.col("level"))
    tests = tests.withColumn("safe", safe)
    failed = F.max(F.when(F.col("safe"), 0).otherwise(1)).over(Window.partitionBy("stratum", "rule").orderBy("step"))
    tests = tests.withColumn("failed", failed).where("failed = 0")
    best = F.max_by(F.struct("cutoff", "n_good", "n_rejected"), "step").alias("b")
    return tests.groupBy("rule", "stratum").agg(best).select("rule", "stratum", "b.*")


def verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang", *, carried: Sequence[str] | None = None, risk: float = RISK, doubt: float = DOUBT) -> DataFrame:
    """document (a struct of the carried columns, all by default), the columns of text_features and kept: false if base_failed, or if a rule's score is above its cutoff.

    Labels are matched by doc_id; rows of labels with a null doc_id or quality match nothing, repeated ones count
    once each. A null stratum is a stratum of its own. A document that no rule has a cutoff for is kept unless the
    base rules fail. Null, empty and blank texts fail the base rules; repeated rows are judged each. Columns of docs
    may have any name. An empty table gives no rows.
    """
    names = docs.columns if carried is None else carried
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("document"), "text", F.col("doc_id").alias("__doc_id"), F.col(f"`{stratum}`").alias("__stratum"))
    features = saved(text_features(own).drop("text"), "quality-features")
    known = labels.select(F.col("doc_id").alias("__id"), F.col("quality").alias("quality")).where("quality is not null")
    labelled = features.select("__doc_id", "__stratum", *FEATURES).join(known, F.col("__doc_id") == F.col("__id"))
    cutoffs = risk_controlled(labelled, "__stratum", risk=risk, doubt=doubt)
    # one row for each stratum; written, so that its size is known and Spark joins a small one without a shuffle of the texts
    wide = cutoffs.groupBy(F.col("stratum").alias("__of")).agg(*[F.max(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"__{rule}") for rule in CUTOFFS])
    wide = saved(wide, "quality-cutoffs")
    out = features.join(wide, F.col("__stratum").eqNullSafe(F.col("__of")), "left")
    rejected = F.col("base_failed")
    for rule, score in scores().items():
        rejected = rejected | F.coalesce(score > F.col(f"__{rule}"), F.lit(False))
    return out.select("document", *FEATURES, (~rejected).alias("kept"))


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang", *, carried: Sequence[str] | None = None, risk: float = RISK, doubt: float = DOUBT) -> DataFrame:
    """verdicts with the carried columns beside the features; a column with the name of a feature, or `kept`, is called `document_` and its name."""
    out = verdicts(docs, labels, stratum, carried=carried, risk=risk, doubt=doubt)
    names = out.schema["document"].dataType.names
    own = [F.col("document").getField(c).alias(f"document_{c}" if c in (*FEATURES, "kept") else c) for c in names]
    return out.select(*own, *FEATURES, "kept")


def kept_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang", *, risk: float = RISK, doubt: float = DOUBT) -> DataFrame:
    """The documents that verdicts keeps, with the columns of docs as they were."""
    out = verdicts(docs, labels, stratum, risk=risk, doubt=doubt).where("kept")
    return out.select(*[F.col("document").getField(c).alias(c) for c in docs.columns])
