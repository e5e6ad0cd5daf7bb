"""Personal data: base patterns against the regular expressions themselves, the trees against examples held out, whole runs against planted spans."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import boosting, pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def check_digit(digits):
    return next(str(c) for c in range(10) if pii.luhn(digits + str(c)))


def fits(kind, own):
    digits = re.sub("[^0-9]", "", own)
    if kind == "ip":
        return all(float(p) <= 255 for p in own.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def plain(text):
    return [[m.span() for m in re.finditer(p, text or "") if fits(k, m[0])] for k, p in PATTERNS.items()]


EDGES = [
    None, "", " ", "@", "a@b", "a@b.c", "x@@y.zz a@b.c@d.e", "a.b+c%d-e_f@h-1.x.y.z.", "é.1@m.de", "1.2.3.4.5.6.7.8", "300.1.2.3.4", "000.01.255.0256", "1.2.3", "9" * 5000 + ".1.2.3",
    "4539 1488 0343 6467", "4539148803436467", "4539-1488-0343-6467 12", "4539148803436467 4539148803436467", "+1 (411) 555-1507", "+1 2", "+12345678", "+1234567890123456", "+1-----2345678.", "++1 234 567 89",
    "a" * 20000, "a" * 20000 + "@", "1 " * 3000, "+1 " * 2000, "mail me: x@y.co +44 20 7946 0958 😀 10.0.0.1 😀", "１２３４５６７８@b.c", "a@b.c,d@e.f", "1-2-3 4 5 - 6",
]


@pytest.mark.parametrize("text", EDGES)
def test_base_patterns(text):
    assert pii.base_spans(text or "") == plain(text)


def test_base_patterns_on_random_texts():
    r = random.Random(4)
    for _ in range(3000):
        text = "".join(r.choices(["1", "23", "456", ".", "@", "a", "b-c", " ", "-", "+", "(", ")", "é", "7890123", "\n"], k=r.randint(1, 40)))
        assert pii.base_spans(text) == plain(text), text


def corpus(n, seed=1):
    """(text, planted spans) of prose with base spans, some disguised, and what looks alike."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices(["ka", "lo", "mi", "ter", "ing", "a", "the"], k=r.randint(1, 3)))
    out = []
    for i in range(n):
        parts, planted, at = [], [], 0
        for _ in range(r.randint(5, 30)):
            own, kind = word() + r.choice(["", "", "", ".", ",", " at", ". At"]), None
            x = r.random()
            card = "".join(r.choices("0123456789", k=15))
            if x < 0.03:
                own, kind = f"{word()}.{r.randint(1, 99)}@mail{r.randint(1, 9)}.example.com", "email"
            elif x < 0.06:
                own, kind = ".".join(str(r.randint(1, 255)) for _ in range(4)), "ip"
            elif x < 0.09:
                own, kind = card + check_digit(card), "card"
            elif x < 0.12:
                own, kind = f"+1 ({r.randint(100, 999)}) 555-{r.randint(1000, 9999)}", "phone"
            elif x < 0.13:
                own, kind = f"{word()} (at) mail{r.randint(1, 9)} (dot) example (dot) com", "hidden"
            elif x < 0.15:
                own = r.choice([str(r.randint(1, 10**9)), "v1.2.3", "token = " + "".join(r.choices("0123456789abcdef", k=30)), f"{r.randint(300, 999)}.1.2.3", "2024-01-02"])
            if kind:
                planted.append((kind, at, at + len(own)))
            parts.append(own)
            at += len(own) + 1
        out.append((" ".join(parts), planted))
    return out


def test_a_whole_run(spark):
    rows = corpus(600)
    data = [(i, t, "clash", 1) for i, (t, _) in enumerate(rows)] + [(9000 + i, t, "clash", 1) for i, t in enumerate(EDGES)] + [(None, rows[0][0], "clash", 1), (0, rows[0][0], "clash", 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, base string, lessons int").repartition(4)
    found = pii.find_personal_data(docs, redact=True)
    assert found.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "redacted"]
    got = found.collect()
    texts = {i: t for i, t, *_ in data}
    added = Counter()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in data)
    for r in got:
        base = plain(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(map(len, base))
        listed = pii.listed(base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r.spans.split(",") if x)]
        assert spans == sorted(spans, key=lambda x: (pii.KINDS.index(x[0]), *x[1:]))
        assert not Counter(listed.split(",") if listed else []) - Counter(r.spans.split(","))
        if r.doc_id is not None and r.doc_id < 9000:
            planted = {("email" if k == "hidden" else k, s, e) for k, s, e in rows[r.doc_id][1]}
            hidden = {("email", s, e) for k, s, e in rows[r.doc_id][1] if k == "hidden"}
            extra = set(spans) - {(k, *s) for k, own in zip(pii.KINDS, base) for s in own}
            added.update(hidden=len(hidden), found=len(hidden & extra), wrong=len(extra - planted))
            for _, s, e in planted & set(spans):
                assert texts[r.doc_id][s:e] not in r.redacted
    assert added["found"] >= 0.9 * added["hidden"] > 40
    assert added["wrong"] <= 0.1 * added["found"]
    again = pii.find_personal_data(docs.repartition(2))
    assert Counter(map(tuple, again.collect())) == Counter(tuple(r)[:-1] for r in got)


def test_empty_and_unlearnt(spark):
    assert pii.find_personal_data(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    (row,) = pii.find_personal_data(spark.createDataFrame([(1, "a (at) b (dot) com and +1 (411) 555-1507")], "doc_id long, text string")).collect()
    assert row.spans == "phone:23:40" and row.n_phone == 1


def test_trees_on_rows_held_out():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0) & (x[:, 2] < 1)).astype(float)
    trees = boosting.fit_trees(x[:3000], y[:3000], np.ones(3000))
    scores = trees.scores(x[3000:])
    assert ((scores > 0) == (y[3000:] > 0)).mean() > 0.95
    cut = boosting.calibrated_threshold(scores, y[3000:], np.ones(1000), 0.98)
    taken = scores >= cut
    assert y[3000:][taken].mean() >= 0.98 and taken.sum() > 0.5 * y[3000:].sum()
    assert boosting.calibrated_threshold(scores, np.zeros(1000), np.ones(1000), 0.9) == float("inf")


def test_spans_are_chosen_apart():
    base = [[(5, 10)], [], [], []]
    spans = [(5, 10), (3, 10), (6, 12), (20, 30), (25, 35), (28, 40)]
    kinds, above = np.array([0, 0, 0, 2, 3, 3]), np.array([9.0, 1.0, 2.0, 3.0, 4.0, -1.0])
    assert pii.chosen(base, kinds, spans, above) == [[(3, 10), (5, 10)], [], [], [(25, 35)]]
    assert pii.redacted("x" * 40, [[(3, 10), (5, 10)], [], [], [(25, 35)]]) == "xxx[EMAIL]" + "x" * 15 + "[PHONE]" + "xxxxx"


def test_the_model_comes_from_all_examples_however_they_are_summed(spark, monkeypatch):
    # 12,000 examples a label: the last key ranges alone show that long ones of the positive label are negative
    rng = np.random.default_rng(1)
    rows = []
    for i in range(24_000):
        x = np.zeros(pii.WIDTH, np.float32)
        late = i >= 12_000
        x[0], x[1], x[2] = rng.integers(0, 40), rng.integers(0, 20), float(late)
        rows.append((0, int((x[0] > 20) != late), i * 1001, x.tobytes()))
    examples = spark.createDataFrame(rows, "kind int, label int, key long, features binary")
    monkeypatch.setattr(pii, "ROUNDS", 6)
    model = pii.fit_model(examples)
    x = np.zeros((4, pii.WIDTH))
    x[:, 0], x[:, 2] = [30, 5, 30, 5], [0, 0, 1, 1]
    assert (model.trees[0].scores(x) > 0).tolist() == [True, False, False, True]
    monkeypatch.setattr(pii, "TOGETHER", 0)
    apart = pii.fit_model(examples.repartition(3))
    assert apart.thresholds == model.thresholds and np.array_equal(apart.trees[0].scores(x), model.trees[0].scores(x))
