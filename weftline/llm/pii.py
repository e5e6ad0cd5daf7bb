"""Personal data: generators propose overlapping spans, boosted trees score them, calibrated thresholds choose."""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.boosting import DEPTH, ROUNDS, Growing, Trees, binned, cuts_of
from weftline.llm.shared import saved
from weftline.llm.wordhash import by_bytes

KINDS = ["email", "ip", "card", "phone"]
#: Rows of equal examples up to which the trees' sums are made on the driver; more are summed where they are.
TOGETHER = 20_000
#: Share of the spans above a threshold that shall be personal data.
PRECISION = 0.98
#: Characters around a span that its features and the examples look at.
AROUND = 40
#: Longest local part and domain of an address (RFC 5321), in characters.
LOCAL, DOMAIN = 80, 260

# The base patterns. Addresses are found from their @ and numbers from the start of their digits, which
# gives the leftmost matches without reading a run of characters once for each of its starts.
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
AT_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# What stands for @ and for a point in addresses that are written out, and words that announce each kind.
OPEN, CLOSE = r"[(\[{<]\s?", r"\s?[)\]}>]"
AT = re.compile(rf"{OPEN}(?:@|[aA][tT]){CLOSE}|@|(?<=\s)[aA][tT](?=\s)")
POINT = rf"(?:\s?\.\s?|\s{{0,2}}{OPEN}(?:[dD][oO][tT]|\.){CLOSE}\s{{0,2}}|\s{{1,2}}[dD][oO][tT]\s{{1,2}})"
LABEL = re.compile(r"[\w-]+")
NEXT_LABEL = re.compile(rf"{POINT}[\w-]+")
LOCAL_END = re.compile(rf"[\w.%+-]+(?:(?:\s{{0,2}}{OPEN}(?:[dD][oO][tT]|\.){CLOSE}\s{{0,2}}|\s{{1,2}}[dD][oO][tT]\s{{1,2}})[\w.%+-]+)*$")
RUN_END = re.compile(r"[\w.%+-]+$")
IP_POINT = rf"(?:\s?\.\s?|{OPEN}\.{CLOSE}|\s?,\s?|\s[dD][oO][tT]\s)"
IP_LIKE = re.compile(rf"(?<![0-9])(?=([0-9]{{1,3}}(?:{IP_POINT}[0-9]{{1,3}}){{3}})(?![0-9]))")
DIGITS = re.compile(r"[0-9]+")
GAP = frozenset(" +().-/_–")
HINTS = re.compile(r"(?i)mail|contact|write to|\btel|phone|call|fax|mobile|card|visa|credit|\bip\b|host|server|addr")
SPELLED = re.compile(r"(?i)(?<=\s)(?:at|dot)(?=\s)")
BRACKETED = re.compile(rf"{OPEN}(?i:at|dot|@|\.){CLOSE}")
SENTENCE = re.compile(r"\.\s[^\W\d_a-z]")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    doubled = [2 * d - 9 if d > 4 else 2 * d for d in map(int, digits[-2::-2])]
    return (sum(doubled) + sum(map(int, digits[-1::-2]))) % 10 == 0


def base_spans(text: str) -> list[list[Span]]:
    """The spans of each kind by the base patterns: leftmost, not overlapping; those that fail their test are dropped."""
    emails, ips, cards, phones = [], [], [], []
    if "@" in text:
        after = 0
        for m in AT_HOST.finditer(text):
            start = m.start()
            while start > after and text[start - 1] in LOCAL_CHARS:
                start -= 1
            if start < m.start():
                emails.append((start, m.end()))
                after = m.end()
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split(".")):
            ips.append(m.span())
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start():
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                cards.append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len("".join(DIGITS.findall(m[0]))) <= 15:
                phones.append(m.span())
    return [emails, ips, cards, phones]


def email_candidates(text: str) -> Iterator[Span]:
    """Around each @, or what stands for it: the characters before it, alone or over points, up to each label behind it."""
    for m in AT.finditer(text):
        left, right = m.start(), m.end()
        while left > max(0, m.start() - 2) and text[left - 1].isspace():
            left -= 1
        while right < min(len(text), m.end() + 2) and text[right].isspace():
            right += 1
        window, ahead = text[max(0, left - LOCAL) : left], text[right : right + DOMAIN]
        host = LABEL.match(ahead)
        starts = {left - len(x[0]) for p in (RUN_END, LOCAL_END) if (x := p.search(window))}
        if not host or not starts:
            continue
        step = NEXT_LABEL.match(ahead, host.end())
        while step:
            for s in sorted(starts):
                yield s, right + step.end()
            step = NEXT_LABEL.match(ahead, step.end())


def number_candidates(text: str, least: int, most: int, signs: bool) -> Iterator[Span]:
    """Runs of whole groups of digits, with little between them, that have least to most digits; a sign before belongs to it if asked."""
    groups = [m.span() for m in DIGITS.finditer(text)]
    for i, (start, _) in enumerate(groups):
        n, before = 0, start
        if signs:
            while before > max(0, start - 2) and text[before - 1] in "+(":
                before -= 1
        for j in range(i, len(groups)):
            a, b = groups[j]
            if j > i and (a - groups[j - 1][1] > 3 or not GAP.issuperset(text[groups[j - 1][1] : a])):
                break
            n += b - a
            if n > most:
                break
            if n >= least:
                yield before, b


def candidates(text: str, kind: int) -> list[Span]:
    """The spans that the generator of a kind proposes; they may overlap."""
    if kind == 0:
        found = email_candidates(text)
    elif kind == 1:
        found = (m.span(1) for m in IP_LIKE.finditer(text))
    else:
        found = number_candidates(text, *((13, 19, False) if kind == 2 else (7, 15, True)))
    return sorted(set(found))


def _side(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 3 if c in ".,;:!?\"'" else 4


def features(text: str, span: Span) -> list[float]:
    """What the trees know of a span: its format and what stands around it."""
    s, e = span
    own, before, after = text[s:e], text[max(0, s - AROUND) : s], text[e : e + AROUND]
    groups = DIGITS.findall(own)
    digits = "".join(groups)
    sizes = [*map(len, groups)] or [0]
    labels = LABEL.findall(own)
    near = lambda x: sum(c.isdigit() for c in x) / AROUND
    return [
        len(own), len(digits), len(groups), max(sizes), min(sizes), sizes[0], sizes[-1], float(bool(digits) and luhn(digits)), own.startswith("+") or own.startswith("00"),
        own.count(" "), own.count("-"), own.count("."), own.count("/") + own.count(","), sum(map(own.count, "()[]{}<>")), sum(c.isalpha() for c in own), sum(c.isupper() for c in own),
        sum(c > "\x7f" for c in own), own.count("@"), len(SPELLED.findall(own)), len(BRACKETED.findall(own)), _side(before[-1:]), _side(after[:1]), near(before), near(after),
        bool(HINTS.search(before)), len(labels[-1]) if labels else 0, bool(SENTENCE.search(own)), max((min(999, int(g[:4])) for g in groups), default=0),
    ]


WIDTH = len(features("", (0, 0)))


def disguises(kind: int, own: str) -> list[str]:
    """A span as it stands, and as people write it to hide it from programs or by other habits."""
    if kind == 0:
        name, host = own.split("@")
        ways = [("@", "."), (" at ", " dot "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" (at) ", " (dot) "), (" @ ", "."), (" at ", "."), (" (at) ", " . "), ("[@]", "[.]"), (" AT ", " DOT ")]
        # local parts of letters alone too, or all would have what the corpus's addresses happen to have
        out = [f"{local}{a}{host.replace('.', p)}" for local in (name, re.sub(r"[\d._%+-]+", "", name) or name) for a, p in ways]
        return [*out, "é" + own, name.replace(".", " dot ") + " at " + host.replace(".", " dot ")]
    if kind == 1:
        return [own.replace(".", p) for p in (".", "[.]", "(.)", " . ", " dot ", ". ", "[.] ".strip())]
    digits = "".join(DIGITS.findall(own))
    if kind == 2:
        fours = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return [own, digits, *(p.join(fours) for p in (" ", "-", ".", "  ", "/", " - ", "_"))]
    groups = DIGITS.findall(own)
    country, rest = groups[0], groups[1:] or [""]
    return [own, own[1:], "00" + own[1:], "00 " + " ".join(groups), *(f"{sign}{p.join(groups)}" for sign in ("+", "") for p in (" ", "-", ".", "/")), f"({country}) {'-'.join(rest)}", f"({rest[0]}) {' '.join(rest[1:])}".strip(), "-".join(rest), ".".join(rest)]


def spoiled(kind: int, own: str, pick: int) -> str:
    """A span turned into what looks like one and is none: a part beyond 255 or a fifth one, a wrong check digit, digits of a longer code."""
    if kind == 1:
        parts = own.split(".")
        at = pick % 6
        return ".".join([*parts, str(pick % 90)] if at == 4 else [str(pick % 90), *parts] if at == 5 else [str(256 + pick % 700) if i == at else p for i, p in enumerate(parts)])
    digits = "".join(DIGITS.findall(own))
    if kind == 2:
        return own[:-1] + str((int(own[-1]) + 1 + pick % 9) % 10)
    ends = "abcdef"
    return f"{ends[pick % 6]}{digits}{ends[pick // 6 % 6]}" if kind == 3 else own


#: What may stand beside a number in a line of figures, so that a base pattern reads on and fails.
BESIDE = ["", "", "", " 20", " 4711", "-7 ", " 123456 "]


@dataclass(frozen=True)
class Lesson:
    kind: int
    label: int
    key: int
    features: bytes


def _lesson(kind: int, label: int, text: str, span: Span, known: list[float] | None = None) -> Lesson:
    s, e = span
    x = np.array(known or features(text, span), np.float32).tobytes()
    seen = f"{kind}:{label}:{text[max(0, s - AROUND) : s]}\0{text[s:e]}\0{text[e : e + AROUND]}"
    return Lesson(kind, label, int.from_bytes(hashlib.blake2b(seen.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True), x)


def lessons(text: str, base: list[list[Span]], proposed: list[tuple[int, int, int]], known: list[list[float]]) -> Iterator[Lesson]:
    """Examples from one text, without labels by hand.

    Positive ones are base spans in their surroundings, each as it stands and in three disguises; what a generator
    proposes there and isn't the span itself is negative, and so is a spoiled span. So is what is proposed in the text
    and touches no base span. Numbers that could be cards, and what holds an @ or stands for one in brackets, may well
    be personal data that the base patterns miss: these have no label.
    """
    every = sorted(x for spans in base for x in spans)
    starts, ends = np.array([s for s, _ in every]), np.maximum.accumulate(np.array([e for _, e in every] or [0]))
    for (kind, s, e), x in zip(proposed, known, strict=True):
        before = int(np.searchsorted(starts, e)) if every else 0  # base spans that start before the end
        own = text[s:e]
        unclear = kind == 2 and 16 <= len(d := "".join(DIGITS.findall(own))) <= 19 and luhn(d) or kind == 0 and ("@" in own or BRACKETED.search(own))
        if (not before or ends[before - 1] <= s) and not unclear:
            yield _lesson(kind, 0, text, (s, e), x)
    for kind, spans in enumerate(base):
        for s, e in spans:
            own, before, after = text[s:e], text[max(0, s - AROUND) : s], text[e : e + AROUND]
            pick = int.from_bytes(hashlib.blake2b((before + own + after).encode("utf-8", "replace"), digest_size=4).digest(), "little")
            forms = disguises(kind, own)
            beside = BESIDE[pick % len(BESIDE)] if kind == 2 else ""
            shown = [(before, own, after)]
            for i in range(3):
                shown.append((before + (beside[::-1] if pick % 2 else ""), forms[(pick // 16 + i * (len(forms) // 3)) % len(forms)], ("" if pick % 2 else beside) + after))
            if kind:
                shown.append((before, spoiled(kind, own, pick), after))
            for n, (left, form, right) in enumerate(shown):
                window, at = left + form + right, (len(left), len(left) + len(form))
                for span in candidates(window, kind):
                    if span[0] < at[1] and span[1] > at[0]:
                        yield _lesson(kind, int(span == at and n < 4), window, span)


@dataclass(frozen=True)
class Model:
    """Trees and a threshold for each kind; a kind without enough examples has an infinite one and adds nothing."""

    trees: list[Trees | None]
    thresholds: list[float]

    def scores(self, kinds: np.ndarray, x: np.ndarray) -> np.ndarray:
        """By how much each candidate is above its kind's threshold."""
        out = np.full(len(x), -np.inf)
        for kind, (trees, threshold) in enumerate(zip(self.trees, self.thresholds, strict=True)):
            own = kinds == kind
            if trees and own.any() and np.isfinite(threshold):
                out[own] = trees.scores(x[own]) - threshold
        return out


def _rows(batch: pa.RecordBatch, column: str, kind: type) -> np.ndarray:
    """The numbers of a binary column, a row each."""
    return np.frombuffer(b"".join(batch[column].to_pylist()), kind).reshape(-1, WIDTH)


def fit_model(examples: DataFrame, precision: float = PRECISION) -> Model:
    """The model from all examples (kind, label, key, features), a written table.

    A quarter, by key, is held out for the thresholds. Cuts come from the counts of each feature's values, which are
    small numbers; examples of equal bins are counted as one row. Each level of the trees is a pass over these rows, for
    all kinds at once, whose sums alone go to the driver; up to TOGETHER rows are summed there, with the same sums.
    """
    spark = examples.sparkSession
    n = {(r.kind, r.label, r.held): r["count"] for r in examples.groupBy("kind", "label", (F.col("key") % 4 == 0).alias("held")).count().collect()}
    of = lambda k, label: n.get((k, label, True), 0) + n.get((k, label, False), 0)
    kinds = [k for k in range(len(KINDS)) if n.get((k, 1, False)) and n.get((k, 1, True)) and of(k, 0)]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, x = batch["kind"].to_numpy(), _rows(batch, "features", np.float32)
            for k in np.unique(own).tolist():
                for j, column in enumerate(x[own == k].T):
                    values, counts = np.unique(column, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(values), pa.int32()), pa.array([j] * len(values), pa.int32()), pa.array(values.astype(float)), pa.array(counts)], ["kind", "feature", "value", "n"])

    seen: dict[tuple[int, int], list[tuple[float, int]]] = {}
    for r in examples.where("key % 4 <> 0").mapInArrow(counted, "kind int, feature int, value double, n long").groupBy("kind", "feature", "value").agg(F.sum("n").alias("n")).collect():
        seen.setdefault((r.kind, r.feature), []).append((r.value, r.n))
    grown: dict[int, Growing] = {}
    for k in kinds:
        cuts = [cuts_of(*np.array(sorted(seen[k, j])).T) for j in range(WIDTH)]
        weight = tuple((of(k, 0) + of(k, 1)) / of(k, label) / 2 for label in (0, 1))
        share = [weight[label] * n.get((k, label, False), 0) for label in (0, 1)]
        grown[k] = Growing(cuts, weight, share[1] / sum(share))
    if not grown:
        return Model([None] * len(KINDS), [float("inf")] * len(KINDS))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, x = batch["kind"].to_numpy(), _rows(batch, "features", np.float32)
            codes = np.zeros(x.shape, np.uint8)
            for k, g in grown.items():
                codes[own == k] = binned(g.cuts, x[own == k].astype(float))
            yield pa.RecordBatch.from_arrays([batch["kind"], batch["label"], batch["held"], pa.array([c.tobytes() for c in codes], pa.binary())], ["kind", "label", "held", "codes"])

    some = examples.where(F.col("kind").isin(kinds)).withColumn("held", F.col("key") % 4 == 0)
    rows = some.mapInArrow(coded, "kind int, label int, held boolean, codes binary").groupBy("kind", "label", "held", "codes").count()
    rows = saved(rows, "pii-binned")
    train = rows.where("not held")

    def summed(batches: Iterator[pa.RecordBatch], trees: dict[int, Growing]) -> dict[int, np.ndarray]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            own, codes = batch["kind"].to_numpy(), _rows(batch, "codes", np.uint8)
            y, count = batch["label"].to_numpy().astype(float), batch["count"].to_numpy()
            for k, g in trees.items():
                if (at := own == k).any():
                    total[k] = total.get(k, 0) + g.sums(codes[at], y[at], count[at])
        return total

    together = train.toArrow().to_batches() if train.count() <= TOGETHER else None
    for _ in range(ROUNDS * DEPTH):
        if together is not None:
            sums = summed(together, grown)
        else:

            def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                own = summed(batches, sent.value)  # noqa: B023
                yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in own.values()], pa.binary())], ["kind", "sums"])

            def added_up(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = sum(np.frombuffer(zlib.decompress(x.as_py()), np.int64) for t in tables for x in t["sums"])
                yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["kind", "sums"])

            sent = spark.sparkContext.broadcast(grown)
            found = train.mapInArrow(part, "kind int, sums binary").groupBy("kind").applyInArrow(added_up, "kind int, sums binary").collect()  # a row for each kind
            sums = {r.kind: np.frombuffer(zlib.decompress(r.sums), np.int64) for r in found}
            sent.unpersist()
        for k, g in grown.items():
            g.split(sums[k])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, codes, out = batch["kind"].to_numpy(), _rows(batch, "codes", np.uint8), np.zeros(batch.num_rows)
            for k, g in grown.items():
                out[own == k] = g.scores(codes[own == k])
            yield pa.RecordBatch.from_arrays([batch["kind"], batch["label"], batch["count"], pa.array(out)], ["kind", "label", "n", "score"])

    least = _thresholds(rows.where("held").mapInArrow(scored, "kind int, label int, n long, score double"), precision)
    # never below even odds
    return Model([grown[k].trees() if k in grown else None for k in range(len(KINDS))], [max(0.0, least.get(k, float("inf"))) for k in range(len(KINDS))])


def _thresholds(scores: DataFrame, precision: float) -> dict[int, float]:
    """Of rows (kind, label, n, score), each kind's smallest score above or at which `precision` are positive, with one
    more negative than seen: running sums over ranges of scores."""
    each = scores.groupBy("kind", "score").agg(F.sum(F.when(F.col("label") > 0, F.col("n")).otherwise(0)).alias("good"), F.sum("n").alias("n"))
    parts = saved(each.repartitionByRange("kind", F.col("score").desc()).withColumn("part", F.spark_partition_id()), "pii-scores")
    earlier = Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.groupBy("kind", "part").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    before = before.select("kind", "part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("good", "n")])
    inside = Window.partitionBy("kind", "part").orderBy(F.col("score").desc())
    run = parts.select("kind", "part", "score", *[F.sum(c).over(inside).alias(c) for c in ("good", "n")]).join(before, ["kind", "part"])
    fine = run.where((F.col("good") + F.col("good_before")) / (F.col("n") + F.col("n_before") + 1) >= precision)
    return {r.kind: r.least for r in fine.groupBy("kind").agg(F.min("score").alias("least")).collect()}


def chosen(base: list[list[Span]], kinds: np.ndarray, spans: list[Span], above: np.ndarray) -> list[list[Span]]:
    """The base spans and the candidates above their thresholds, the highest first, that touch nothing chosen before.

    A candidate may touch base spans of its own kind only if it goes beyond them on both or one side and holds them whole.
    """
    out = [list(s) for s in base]
    taken = sorted((s, e, k) for k, own in enumerate(base) for s, e in own)
    longest = max((e - s for s, e, _ in taken), default=0)
    new: list[Span] = []
    for i in sorted(np.flatnonzero(above >= 0).tolist(), key=lambda i: (-above[i], kinds[i], spans[i])):
        (s, e), kind = spans[i], int(kinds[i])
        touched = [t for t in taken[bisect_left(taken, (s - longest,)) : bisect_left(taken, (e,))] if t[1] > s]
        at = bisect_left(new, (s, e))
        beside = new[max(0, at - 1) : at + 1]  # chosen ones don't touch each other
        if any(k != kind or a < s or b > e or (a, b) == (s, e) for a, b, k in touched) or any(a < e and b > s for a, b in beside):
            continue
        new.insert(at, (s, e))
        out[kind].append((s, e))
    return [sorted(s) for s in out]


def listed(spans: list[list[Span]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for kind, own in zip(KINDS, spans, strict=True) for s, e in own)


def redacted(text: str, spans: list[list[Span]]) -> str:
    """The text with each span replaced by its kind in brackets; spans that touch are one, of the first one's kind."""
    out, at = [], 0
    for s, e, kind in sorted((s, -e, kind) for kind, own in zip(KINDS, spans, strict=True) for s, e in own):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, -e)
    return "".join([*out, text[at:]])


def find_personal_data(docs: DataFrame, *, redact: bool = False, precision: float = PRECISION) -> DataFrame:
    """One row for each document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans; with redact, the text without them.

    The counts and base_sha256 are of the base patterns' spans. spans lists these and the spans that the model adds, as
    kind:start:end by kind and start, in code points with the end exclusive. Null texts count as empty; empty ones have
    no spans and the digest of ''. Repeated rows are read each; other columns are not read; an empty table gives no rows.

    Texts are read once, where they are: base spans, candidates and examples are written. The trees are fitted on
    all different examples, and their thresholds set on all that are held out; they go to every executor.
    A kind of which no base span shows an example, for training and held out, adds no span.
    """
    kind_of_id = dict(docs.dtypes)["doc_id"]

    def proposed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in by_bytes(b, 4 << 20)):
            rows, examples, ends = [], [], [0]
            for text in batch["text"].to_pylist():
                text = text or ""
                base = base_spans(text)
                flat = [(k, *span) for k in range(len(KINDS)) for span in candidates(text, k)]
                known = [features(text, f[1:]) for f in flat]
                rows.append(([[i for span in own for i in span] for own in base], np.array(flat, np.int32).tobytes(), np.array(known, np.float32).tobytes(), text if redact else None))
                examples += lessons(text, base, flat, known)
                ends.append(len(examples))
            types = [pa.list_(pa.list_(pa.int32())), pa.binary(), pa.binary(), pa.string()]
            base, found, known, texts = (pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True))
            parts = [pa.array([getattr(e, name) for e in examples], t) for name, t in (("kind", pa.int32()), ("label", pa.int32()), ("key", pa.int64()), ("features", pa.binary()))]
            lesson = pa.StructArray.from_arrays(parts, ["kind", "label", "key", "features"])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], base, found, known, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lesson), texts], ["doc_id", "base", "candidates", "features", "lessons", "text"])

    schema = f"doc_id {kind_of_id}, base array<array<int>>, candidates binary, features binary, lessons array<struct<kind:int, label:int, key:long, features:binary>>, text string"
    rows = saved(docs.select("doc_id", "text").mapInArrow(proposed, schema), "pii-candidates")
    each = rows.select(F.explode("lessons").alias("e")).select("e.*")
    different = saved(each.groupBy("kind", "label", "key").agg(F.min("features").alias("features")), "pii-examples")
    model = docs.sparkSession.sparkContext.broadcast(fit_model(different, precision))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = [np.frombuffer(x.as_py(), np.int32).reshape(-1, 3) for x in batch["candidates"]]
            x = np.concatenate([np.frombuffer(v.as_py(), np.float32) for v in batch["features"]] or [np.zeros(0, np.float32)]).reshape(-1, WIDTH)
            above = model.value.scores(np.concatenate([f[:, 0] for f in flat] or [np.zeros(0)]), x.astype(float))
            out, at = [], 0
            for f, raw, text in zip(flat, batch["base"].to_pylist(), batch["text"].to_pylist(), strict=True):
                base = [list(zip(own[::2], own[1::2], strict=True)) for own in raw]
                spans = chosen(base, f[:, 0], [tuple(s) for s in f[:, 1:].tolist()], above[at : at + len(f)])
                at += len(f)
                out.append((*map(len, base), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), redacted(text, spans) if redact else None))
            columns = list(zip(*out, strict=True)) or [()] * 7
            arrays = [*(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *arrays], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "redacted"])

    out = rows.drop("lessons").mapInArrow(added, f"doc_id {kind_of_id}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string")
    return out if redact else out.drop("redacted")
