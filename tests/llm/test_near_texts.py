"""near_texts against brute force where links are hard to find: edits up to the bound, short texts, passages of many texts."""

import random

import numpy as np
import pytest

from weftline.llm import near_texts


def fresh(r, n):
    return [f"w{r.randrange(10**9)}" for _ in range(n)]


def edited(r, words, edits):
    """words with so many edits at random places: replacements, and as many insertions as deletions."""
    out = list(words)
    for at in sorted(r.sample(range(len(words)), edits), reverse=True):
        kind = r.randrange(4)
        if kind == 0:
            out[at : at + 1] = []
        elif kind == 1:
            out[at:at] = fresh(r, 1)
        else:
            out[at] = fresh(r, 1)[0]
    return out


def classes(spark, texts):
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    return {x.doc_id: x.class_id for x in near_texts.near_texts(rows).collect()}


def same_classes(texts, got):
    """The classes are those of brute force."""
    code = {w: i for i, w in enumerate({w for t in texts for w in t})}
    coded = [np.array([code[w] for w in t]) for t in texts]
    want = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if want[i] != want[j] and near_texts.similar(coded[i], coded[j], 0.8):
                old, new = max(want[i], want[j]), min(want[i], want[j])
                want = [new if x == old else x for x in want]
    assert [got[i] for i in range(len(texts))] == want


def test_planted_pairs_at_the_bound(spark):
    r, texts = random.Random(1), []
    for n in (25, 30, 50, 100, 300):
        for edits in (n // 10, n * 3 // 20, n // 5):
            for _ in range(6):
                base = fresh(r, n)
                texts += [base, edited(r, base, edits)]
    base = fresh(r, 100)
    texts += [base, [f"x{i}" if i % 5 == 2 else w for i, w in enumerate(base)]]  # every fifth word
    same_classes(texts, classes(spark, texts))


def test_short_texts_are_exact(spark):
    r, texts = random.Random(2), []
    for n in range(1, 26):
        for _ in range(5):
            base = fresh(r, n)
            texts += [base, edited(r, base, n // 5)]
    base = fresh(r, 9)
    texts += [base, [*base[:4], "middle", *base[5:]]]
    vocabulary = fresh(r, 3)
    texts += [list(t) for t in {tuple(r.choices(vocabulary, k=r.randint(5, 9))) for _ in range(40)}]
    same_classes(texts, classes(spark, texts))


def test_segments_miss_no_similar_pair():
    r = random.Random(3)
    for _ in range(3000):
        a = np.array([r.randrange(4) for _ in range(r.randint(1, 20))], np.uint32)
        b = np.array([int(w) for w in edited_numbers(r, a)], np.uint32)
        if len(b) and near_texts.similar(a, b, 0.8):
            longer, shorter = sorted((a, b), key=len, reverse=True)
            assert set(near_texts.segment_keys(longer)[0]) & set(near_texts.segment_keys(shorter)[1])


def test_rare_words_miss_no_similar_pair():
    r = random.Random(3)
    counts = np.array([r.randrange(50) for _ in range(64)])
    for _ in range(3000):
        a = np.array([r.randrange(4) for _ in range(r.randint(1, 20))], np.uint32)
        b = np.array([int(w) for w in edited_numbers(r, a)], np.uint32)
        if len(b) and near_texts.similar(a, b, 0.8):
            x, y = (near_texts.rare_labels(near_texts._labels(t), counts) for t in (a, b))
            assert set(x.tolist()) & set(y.tolist())


def test_long_texts_align_within_bounded_memory():
    r = np.random.default_rng(1)
    a = r.integers(0, 40_000, 60_000).astype(np.uint32)
    b = a.copy()
    b[r.choice(len(b), 400, replace=False)] = 99_999
    assert near_texts.edit_distance(a, b, 12_000) == 400
    assert near_texts.edit_distance(a, np.concatenate([a[300:], a[:100]]), 150) == 151


def edited_numbers(r, a):
    out = a.tolist()
    for _ in range(r.randint(0, 5)):
        at = r.randrange(len(out) + 1)
        out[at : at + r.randrange(2)] = [r.randrange(4)] * r.randrange(2)
    return out


@pytest.mark.parametrize("small", [8, near_texts.SMALL])
def test_near_copies_among_texts_that_share_a_passage(spark, monkeypatch, small):
    monkeypatch.setattr(near_texts, "SMALL", small)
    r = random.Random(4)
    passage = fresh(r, 70)
    texts = [passage + fresh(r, 30) for _ in range(150)]
    for k in range(0, 60, 3):  # similarity 0.90, the edits in the own part
        own = texts[k][70:]
        texts.append(passage + [f"y{k}_{i}" if i % 3 == 1 else w for i, w in enumerate(own)])
    same_classes(texts, classes(spark, texts))


@pytest.mark.parametrize("block", [16, 512])
def test_texts_beside_a_large_group_find_the_one_member_they_are_linked_to(spark, monkeypatch, block):
    monkeypatch.setattr(near_texts, "SMALL", 8)
    monkeypatch.setattr(near_texts, "BLOCK", block, raising=False)
    r = random.Random(5)
    center = fresh(r, 1000)
    members = [center[: 50 * i] + center[50 * i + 50 : 50 * j] + center[50 * j + 50 :] for j in range(20) for i in range(j)]
    beside = [m + fresh(r, 220) for m in members[::16]]  # 220 edits of 224 from that member, 270 or more from all others
    got = classes(spark, [center, *members, *beside])
    assert set(got.values()) == {0}


def test_word_counts_and_marks_turn_away_no_similar_pair_but_most_others():
    r = random.Random(6)
    texts = []
    for n in (30, 100, 400):
        for _ in range(20):
            base = fresh(r, n)
            texts += [base, edited(r, base, n // 5)]
    code = {w: i for i, w in enumerate({w for t in texts for w in t})}
    words = [near_texts.mix(np.array([code[w] for w in t], np.uint64)) for t in texts]
    first = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    marks = near_texts.order_sketches(np.concatenate(words), first)[1].view(np.int64)
    counts = near_texts.word_counts((np.concatenate(words) >> np.uint64(32)).astype(np.uint32), first).view(np.int64)
    n = np.diff(first)
    pair = lambda i, j: (
        near_texts.marks_let(n[i], n[j], [m[i] for m in marks.T], [m[j] for m in marks.T], 0.8),
        near_texts.counts_let(np.maximum(n[i], n[j]), [c[i] for c in counts.T], [c[j] for c in counts.T], 0.8),
    )
    i, j = np.triu_indices(len(texts), 1)
    by_marks, by_counts = pair(i, j)
    same = (i // 2 == j // 2) & np.array([near_texts.similar(words[a], words[b], 0.8) if a // 2 == b // 2 else False for a, b in zip(i, j, strict=True)])
    assert by_counts[same].all() and by_marks[same].mean() > 0.98
    equal_length = np.minimum(n[i], n[j]) >= 0.8 * np.maximum(n[i], n[j])
    assert by_marks[~same & equal_length].mean() < 0.01  # four-bit marks let 0.14 of unrelated pairs pass


@pytest.mark.parametrize("run", [1, 2, 3])
def test_no_similar_text_lacks_more_runs_of_words_than_may_lack_says(run):
    r = random.Random(7)
    for most in (1, 4, 20, 60):
        for _ in range(500):
            a = np.array([r.randrange(6) for _ in range(r.randint(1, most))], np.uint32)
            b = np.array([int(w) for w in edited_numbers(r, a)], np.uint32)
            if len(b) and near_texts.similar(a, b, 0.8):
                x, y = (set(near_texts._labels(t, run).tolist()) for t in (a, b))
                assert len(x - y) <= near_texts.may_lack(len(a), run) and len(y - x) <= near_texts.may_lack(len(b), run)


def test_texts_with_a_passage_and_common_words_alone_make_no_rows_of_rare_words(spark, monkeypatch):
    monkeypatch.setattr(near_texts, "SMALL", 8)
    made, saved = {}, near_texts.saved

    def counted(df, name):
        out = saved(df, name)
        if name == "near-rare":
            made[name] = out.count()
        return out

    monkeypatch.setattr(near_texts, "saved", counted)
    r = random.Random(8)
    passage, vocabulary = fresh(r, 30), fresh(r, 400)
    texts = [passage + r.choices(vocabulary, k=70) for _ in range(120)]
    texts += [edited(r, t, 20) for t in texts[:60:3]]  # with 20 edits of 100 words, at the bound
    same_classes(texts, classes(spark, texts))
    assert made["near-rare"] < len(texts) * 4  # a row for 21 words of each before
