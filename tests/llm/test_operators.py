"""The operators against brute force, and their edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from weftline.llm import catalog, license_scan, lm_score, mix, near_texts, near_vectors, packing, quality, shard, token_bits, token_count, url_filter  # noqa: E402
from weftline.llm.graph import components  # noqa: E402

SPACE = "[\x20\x09-\x0d]+"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
R = random.Random(5)
LETTERS = ["ka", "lo", "mi", "ter", "ous", "été", "ing", "a", "the", "Of"]


def words_of(text):
    return [w for w in re.split(SPACE, text or "") if w]


def prose(n):
    return " ".join("".join(R.choices(LETTERS, k=R.randint(1, 4))) for _ in range(n))


EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "null id text"), (5, "x" * 20_000), (6, "tab\tand  two spaces \n end "), (7, " leading"), (8, "é<|endoftext|>\x1codd space")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = EDGES + [(10 + i, prose(R.randint(20, 300))) for i in range(60)] + [(100, prose(4000))]
    rows += [(200 + i, rows[20][1]) for i in range(5)]  # copies
    base = rows[30][1].split(" ")
    for i in range(5):  # near copies
        w = list(base)
        w[R.randrange(len(w))] = f"changed{i}"
        rows.append((300 + i, " ".join(w)))
    data = [(i, t, "xy"[k % 2] if k % 7 else None, "en", k, "clash", "clash") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, source string, lang string, n_chars long, node string, queue string").repartition(3)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text, r.source) for r in docs.collect()]


def test_token_counts(docs, rows):
    got = Counter((r.doc_id, r.n_words) for r in token_count.count_tokens(docs, TOKENIZER).collect())
    assert got == Counter((i, len((t or "").encode().split())) for i, t, _ in rows)
    a = token_count.Automaton([b"a", b"ab", b"abc", b"b", b"cab"])
    pieces = {b"a", b"ab", b"abc", b"b", b"cab"}

    def greedy(word):
        n, at = 0, 0
        while at < len(word):
            k = max((k for k in range(1, 4) if word[at : at + k] in pieces), default=0)
            if not k:
                return -1
            n, at = n + 1, at + k
        return n

    for _ in range(2000):
        w = bytes(R.choices(b"abcd", k=R.randint(0, 9)))
        assert a.count(w) == greedy(w)


def test_sharding(docs, rows):
    out = shard.shard_documents(docs, catalog.SHARDS, catalog.GROWN).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    by = defaultdict(list)
    for r in out:
        assert r.grown_shard in (r.shard, 8)
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_mixing(docs, rows):
    out = mix.mix_plan(docs).collect()
    assert Counter((r.doc_id, r.size) for r in out) == Counter((i, len(words_of(t))) for i, t, _ in rows)
    taken = defaultdict(int)
    for r in out:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source, r.target] += r.taken
    assert all(abs(n - target) <= 2 * mix.PACKET for (_, target), n in taken.items())
    assert sum(taken.values()) == sum(r.size for r in out)
    assert Counter(out) == Counter(mix.mix_plan(docs.repartition(5)).collect())
    assert set(mix.mixed_documents(docs).columns) == set(docs.columns)


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for i, text, _ in rows:
        want[i, tuple([*t.encode(text or "", add_special_tokens=False).ids, 0])] += 1
    out = sorted(packing.pack(docs, TOKENIZER).collect(), key=lambda r: (r.sequence_id, r.offset))
    place, pieces = 0, defaultdict(list)
    for r in out:
        assert r.sequence_id * 1024 + r.offset == place and r.length <= 1024 and zlib.crc32(r.ids) == r.ids_crc32
        place += r.length
        pieces[r.doc_id].append(r)
    for doc_id, own in pieces.items():
        ids = [k for (i, k), n in want.items() if i == doc_id for _ in range(n)]
        assert sum(map(len, ids)) == sum(r.length for r in own)
        if len(ids) == 1:
            own.sort(key=lambda r: r.start)
            assert np.frombuffer(b"".join(r.ids for r in own), "<u4").tolist() == list(ids[0])


def round_robin(tokens, weights, window):
    """The queue of each token, by running every round with credits and deficits."""
    window, out = max(window, packing.LEAST * len(tokens)), []
    sent, owed = [0] * len(tokens), [0.0] * len(tokens)
    while len(out) < sum(tokens):
        active = [q for q in range(len(tokens)) if tokens[q] > sent[q]]
        total = sum(weights[q] for q in active)
        for q in active:
            owed[q] += window * weights[q] / total
            n = min(int(owed[q] + 1e-9), tokens[q] - sent[q])
            sent[q], owed[q] = sent[q] + n, owed[q] - n
            out += [q] * n
    return out


@pytest.mark.parametrize("tokens,weights", [([100_000, 40_000, 7, 60_000], [1.0, 2.0, 1.0, 4.0]), ([30_000] * 5, [5.0, 1.0, 1.0, 2.0, 3.0]), ([40] * 5000, [1.0] * 5000)])
def test_packing_is_a_deficit_round_robin(tokens, weights):
    s = packing.Schedule(tokens, weights)
    seen = np.zeros(sum(tokens), int) - 1
    for q, n in enumerate(tokens):
        for first in range(0, n, 997):  # as documents
            for _, length, place in s.pieces(q, first, min(997, n - first)):
                assert (seen[place : place + length] == -1).all()
                seen[place : place + length] = q
    want = np.array(round_robin(tokens, weights, packing.WINDOW))
    assert (seen >= 0).all() and (np.bincount(seen) == tokens).all()
    # floors may fall one token apart where a credit is whole but for rounding
    at = np.arange(0, len(seen) + 1, s.window)
    for q in range(min(len(tokens), 5)):
        assert np.abs(np.cumsum(seen == q)[at[1:] - 1] - np.cumsum(want == q)[at[1:] - 1]).max(initial=0) <= 1


def test_packing_shares_tokens_by_default():
    tokens = [100_000, 40_000, 7, 60_000]
    s = packing.Schedule(tokens)
    for r in range(1, s.rounds - 1):
        share = (s.sent(r + 1) - s.sent(r)) / packing.WINDOW
        assert np.abs(share - np.array(tokens) / sum(tokens)).max() < 0.001


def test_packing_with_target_weights(spark):
    rows = [(i, prose(40), "ab"[i % 2]) for i in range(40)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), TOKENIZER, {"a": 3.0}, sequence=128, window=64).collect()
    n = Counter()
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        n[r.source] += r.length
        if n["a"] < 1000:
            assert abs(n["a"] - 3 * n["b"]) < 3 * 64
    assert sum(n.values()) == max(r.sequence_id * 128 + r.offset + r.length for r in out)


def test_near_texts(docs, rows):
    out = near_texts.near_texts(docs).collect()
    assert len(out) == len(rows)
    classes = {r.doc_id: r.class_id for r in out}
    assert {classes[i] for i in range(200, 205)} == {classes[20]} or len({classes[i] for i in range(200, 205)}) == 1
    assert len({classes[i] for i in range(300, 305)}) == 1
    texts = [(i, np.array([zlib.crc32(w.encode()) for w in words_of(t)])) for i, t, _ in rows if i is not None and words_of(t)]
    for k, (i, a) in enumerate(texts):  # brute force: no link is lost, clean documents stay alone
        for j, b in texts[:k]:
            if near_texts.similar(a, b, 0.8):
                assert classes[i] == classes[j]
    sizes = Counter(r.class_id for r in out)
    kept = Counter(r.class_id for r in out if r.kept)
    assert all(kept[c] == 1 for c in sizes if c is not None)
    assert sizes[50] == 1


def test_banded_alignment():
    def plain(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    for _ in range(800):
        a, b = ([R.randint(0, 4) for _ in range(R.randint(0, 14))] for _ in range(2))
        most = R.randint(0, 8)
        assert near_texts.edit_distance(np.array(a, int), np.array(b, int), most) == min(plain(a, b), most + 1)


def test_quality_features_and_cutoffs(spark, docs, rows):
    def want(t):
        t = t or ""
        w = words_of(t)
        windows, covered = Counter(zip(w, w[1:], w[2:])), set()
        for i in range(len(w) - 2):
            if windows[tuple(w[i : i + 3])] > 1:
                covered |= {i, i + 1, i + 2}
        lines = [x for x in t.split("\n") if words_of(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)

    labels = spark.createDataFrame([], "doc_id long, quality int")
    more = spark.createDataFrame([(1, "a a a a a\nb # b\nb # b\n\n", None, None, 0, "", "")], docs.schema)
    out = quality.judged(docs.unionByName(more), labels).collect()
    for r in out:
        assert want(r.text) == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert r.kept == (not (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words))

    def tail(k, n, p):
        total, term = 0.0, (1 - p) ** n
        for i in range(k + 1):
            total += term
            term *= (n - i) / (i + 1) * p / (1 - p)
        return total

    good = [(s, 1, False, 100, 500, 100 if i < bad else 0, 0, 0, 10) for s, n, bad in (("big", 4000, 5), ("small", 100, 0)) for i in range(n)]
    labelled = spark.createDataFrame(good, "lang string, quality int, base_failed boolean, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long")
    cut = {(r["rule"], r.stratum): r.cutoff for r in quality.risk_controlled(labelled, "lang").collect()}
    safe = tail(5, 4000, quality.RISK / 3) <= quality.DOUBT / 6
    assert cut[("symbols", "big")] == (0.02 if safe else 0.2) and ("symbols", "small") not in cut


def test_lm_score(docs, rows):
    tokens = [(i, [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words_of(t)] + [""]) for i, t, _ in rows]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = Counter(w for i, ws in tokens if not held(i) for w in ws)
    total, kinds = sum(c.values()), len(c)
    want = Counter((i, held(i), len(ws), sum(c[w] > 0 for w in ws), round(sum(np.log10((c[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in ws), 6)) for i, ws in tokens)
    out = lm_score.score_documents(docs).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in out) == want
    assert all(r.score < 0 and np.isfinite(r.score) and r.train_tokens == total for r in out)


def test_lm_probabilities_sum_to_one_at_most():
    weights = lm_score._first_weights()
    tables = [[np.zeros(1 << b, np.float32) for b in lm_score.TABLE_BITS] for _ in range(2)]
    model = lm_score.Predictors(*tables, weights)
    words = pa.array([bytes([b]).decode("latin-1") for b in range(128) if b != 32])
    p = 10 ** lm_score.spelled(words, model)
    assert 0 < p.sum() <= 1


def plain_spelling(word, model):
    """The log10 probability of a word and its space, bit by bit over plain integers."""
    full, total, before = 2**64 - 1, 0.0, []

    def spread(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & full
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & full
        return x ^ (x >> 31)

    for byte in word.encode() + b" ":
        contexts, h = [], 0
        for back in range(1, max(lm_score.ORDERS) + 1):
            h = (h * 0x100000001B3 + (before[-back] if back <= len(before) else 0) + 1) & full
            if back in lm_score.ORDERS:
                contexts.append(spread((h + back) & full))
        for bit in range(8):
            node, one = (1 << bit) | (byte >> (8 - bit)), (byte >> (7 - bit)) & 1
            odds, seen = [], 0
            for k, (c, size) in enumerate(zip(contexts, lm_score.TABLE_BITS, strict=True)):
                at = ((c ^ (node * 0x9E3779B97F4A7C15 & full)) * 0xD6E8FEB86659FD93 & full) >> (64 - size)
                z, o = float(model.zeros[k][at]), float(model.ones[k][at])
                seen += z + o > 0
                odds.append(min(max(np.log((o + lm_score.PSEUDO) / (z + lm_score.PSEUDO)), -lm_score.MOST), lm_score.MOST))
            w = model.weights[bit * (len(lm_score.ORDERS) + 1) + seen]
            p = 1 / (1 + np.exp(-sum(a * b for a, b in zip(w, odds + [0.3], strict=True))))
            total += np.log10(p if one else 1 - p)
        before.append(byte)
    return total


def log_odds(one, zero):
    return min(max(np.log((one + token_bits.PSEUDO) / (zero + token_bits.PSEUDO)), -token_bits.MOST), token_bits.MOST)


def plain_spread(x):
    full = 2**64 - 1
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & full
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & full
    return x ^ (x >> 31)


def plain_slots(words, i, node):
    """The slot of each hashed context of words[i] for a node."""
    full, h, out = 2**64 - 1, 0, []
    for back in range(1, max(token_bits.WORDS_BEFORE) + 1):
        h = plain_spread((h + (zlib.crc32(words[i - back].encode()) + 1 if i >= back else 0) + back) & full)
        if back in token_bits.WORDS_BEFORE:
            size = token_bits.TABLE_BITS[len(out)]
            out.append(((h ^ (node * 0x9E3779B97F4A7C15 & full)) * 0xD6E8FEB86659FD93 & full) >> (64 - size))
    return out


def code_of(word):
    return zlib.crc32(word.encode()) % token_bits.NODES


def plain_tables(texts):
    """Zeros and ones by table and slot, over the words of all training texts."""
    tables = [defaultdict(lambda: [0, 0]) for _ in token_bits.TABLE_BITS]
    for words in texts:
        for i, w in enumerate(words):
            for b in range(token_bits.CODE):
                node = (1 << b) | (code_of(w) >> (token_bits.CODE - b))
                for table, at in zip(tables, plain_slots(words, i, node), strict=True):
                    table[at][(code_of(w) >> (token_bits.CODE - 1 - b)) & 1] += 1
    return tables


def plain_score(words, c, tables, spelling):
    """The log10 probability of a document's words, one after another; weights and counters move after each step."""
    by_code = Counter()
    for w, n in c.items():
        by_code[code_of(w)] += n
    once, total = sum(n == 1 for n in c.values()), sum(c.values())
    ends = [*token_bits.STEPS]
    while ends[-1] <= len(words):
        ends.append(ends[-1] + token_bits.LAST_STEP)
    weights, counters = token_bits.START.astype(float), np.zeros((token_bits.COUNTERS, 2))
    taught, score, was_hit = [], 0.0, False

    def decide(gate, corpus, hashed, counter, hint, value):
        x = np.array([corpus, *hashed, log_odds(counters[counter][1], counters[counter][0]), hint])
        p = 1 / (1 + np.exp(-min(max(weights[gate] @ x, -20), 20)))
        taught.append((gate, (value - p) * x, counter, value))
        return np.log10(p if value else 1 - p)

    for i, w in enumerate(words):
        before = [j for j in range(i - 1) if words[j] == words[i - 1]] if i else []
        foreseen = words[before[-1] + 1] if before else None
        state, f_known = 0 if foreseen is None else 2 if was_hit else 1, foreseen is not None and c[foreseen] > 0
        score += decide(token_bits.KNOWN + state, log_odds(total - once, once), (0, 0), token_bits.DOC_KNOWN, 0 if foreseen is None else 1 if f_known else -1, int(c[w] > 0))
        if c[w]:
            agrees = f_known
            for b in range(token_bits.CODE):
                shift = token_bits.CODE - b
                node, value = (1 << b) | (code_of(w) >> shift), (code_of(w) >> (shift - 1)) & 1
                told = (code_of(foreseen) >> (shift - 1)) & 1 if agrees else None
                ones, zeros = (sum(n for k, n in by_code.items() if k >> (shift - 1) == ((node << 1) | v) - (2 << b)) for v in (1, 0))
                hashed = [log_odds(t[at][1], t[at][0]) if at in t else 0 for t, at in zip(tables, plain_slots(words, i, node), strict=True)]
                score += decide(3 * b + (state if agrees else 0), log_odds(ones, zeros), hashed, node, 0 if told is None else 2 * told - 1, value)
                agrees = agrees and told == value
            same = [v for v in words[:i] if c[v] and code_of(v) == code_of(w)]
            rest = by_code[code_of(w)]
            if same:
                its = c[same[-1]]
                score += decide(token_bits.AGAIN + (same[-1] == foreseen), log_odds(its, rest - its), (0, 0), 0, int(same[-1] == foreseen), int(same[-1] == w))
                rest -= its
            if not same or same[-1] != w:
                score += np.log10(c[w] / rest)
        else:
            new = [v for v in words[:i] if not c[v]]
            if new:
                score += decide(token_bits.UNKNOWN_AGAIN, -1.0, (0, 0), token_bits.DOC_UNKNOWN_AGAIN, int(foreseen is not None and not f_known), int(w in new))
            score += np.log10(new.count(w) / len(new)) if w in new else spelling(w)
        was_hit = foreseen == w
        if i + 1 in ends:
            times = Counter(gate for gate, *_ in taught)
            for gate, move, counter, value in taught:
                weights[gate] += token_bits.RATE * move / (times[gate] + token_bits.PRIOR)
                counters[counter][value] += 1
            taught.clear()
    return score


def test_lm_token_probabilities_sum_to_one():
    """Over all words that may come next after a text: the known ones, which hold every code, and the unknown ones as one."""
    rng, n = np.random.default_rng(5), 2500
    words = np.array([zlib.crc32(b"w%d" % i) for i in range(n + 1)], np.uint32)
    c = np.append(rng.integers(1, 50, n), 0)
    codes = words & np.uint32(token_bits.NODES - 1)
    assert len(set(codes[:n])) == token_bits.NODES
    tables = [rng.integers(0, 9, (2, 1 << b)) for b in token_bits.TABLE_BITS]
    corpus = token_bits.Corpus.of(tables, np.bincount(codes, c, token_bits.NODES).astype(np.int64), int((c == 1).sum()))
    text = rng.integers(0, 40, 70)
    text[40:50] = text[10:20]
    text[69] = text[15]
    tails = np.arange(n + 1)  # an unknown word would be spelled, here with certainty, as the text holds no other
    token = np.concatenate([np.append(text, t) for t in tails])
    score = token_bits.token_scores(np.repeat(tails, 71), token, words, c, np.zeros(n + 1), corpus)
    assert np.isclose((10 ** score.reshape(n + 1, 71)[:, -1]).sum(), 1, atol=1e-4)


def trained_model(words):
    """Counts over words and uneven weights."""
    rng = np.random.default_rng(11)
    tables = [[np.zeros(1 << b, np.float32) for b in lm_score.TABLE_BITS] for _ in range(2)]
    for part in lm_score.letters(pa.array(words), 1000):
        for bit in range(8):
            value = (part.byte >> (7 - bit)) & 1
            for k, at in enumerate(lm_score.slots(part, bit)):
                for v in (0, 1):
                    np.add.at(tables[v][k], at[value == v], 1)
    return lm_score.Predictors(*tables, lm_score._first_weights() + rng.normal(0, 0.05, (lm_score.GATES, len(lm_score.ORDERS) + 1)))


def test_lm_score_by_a_plain_model(docs, rows, monkeypatch):
    lowered = {(i, t): [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words_of(t)] + [""] for i, t, _ in rows}
    c = Counter(w for i, t, _ in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 10 for w in lowered[i, t])
    model = trained_model(sorted(w for w in c if w))
    monkeypatch.setattr(lm_score, "_predictors", lambda lexicon: model)
    spell = {}

    def spelling(w):
        if w not in spell:
            spell[w] = plain_spelling(w, model)
        return spell[w]

    tables = plain_tables(lowered[i, t] for i, t, _ in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 10)
    want = defaultdict(list)
    for i, t, _ in rows:
        want[i].append(plain_score(lowered[i, t], c, tables, spelling))
    got = defaultdict(list)
    for r in lm_score.score_documents(docs).collect():
        got[r.doc_id].append(r.score)
    assert got.keys() == want.keys()
    for i in want:
        assert np.allclose(sorted(got[i]), sorted(want[i]), rtol=1e-4, atol=1e-3)


def test_lm_spelling_of_cut_words():
    words = ["ab" * 4000, "", "été", "x", "the" * 700]
    model = trained_model(words)
    whole = lm_score.spelled(pa.array(words), model)
    for step in (1, 7, 1000):
        parts = list(lm_score.letters(pa.array(words), step))
        full = next(lm_score.letters(pa.array(words), 1 << 20))
        assert (np.concatenate([p.byte for p in parts]) == full.byte).all() and all((np.concatenate([p.context[k] for p in parts]) == full.context[k]).all() for k in range(len(full.context)))
    assert np.allclose(whole, [plain_spelling(w, model) for w in words], rtol=1e-4)


def test_lm_spelling_of_a_very_long_word(monkeypatch):
    monkeypatch.setattr(lm_score, "STEP", 1 << 10)
    tracemalloc.start()
    score = lm_score.spelled(pa.array(["z" * (1 << 18)]), trained_model(["zoo"]))
    assert np.isfinite(score).all() and tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()


@pytest.mark.parametrize("plane", [False, True])
def test_near_vectors_over_many_cells(spark, monkeypatch, plane):
    """Exact links of 3,000 vectors, whose index has 144 cells a label, in 16 dimensions or in 3 of these."""
    monkeypatch.setattr(near_vectors, "CELL", 10)
    monkeypatch.setattr(near_vectors, "MEMBERS", 16)
    monkeypatch.setattr(near_vectors, "VISITORS", 32)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(1000, 16))
    turn = rng.normal(size=(3, 16))
    if plane:
        base = rng.normal(size=(1000, 3)) @ turn
    noise = (lambda: 0.08 * rng.normal(size=3) @ turn) if plane else (lambda: 0.1 * rng.normal(size=16))
    x = np.array([base[i % 1000] + (noise() if i >= 1000 else 0) for i in range(3000)]).astype(np.float32)
    x[2990:] = x[:10]  # copies
    label = [i % 1000 % 2 for i in range(3000)]
    df = spark.createDataFrame([(i, v.tolist(), lab) for i, (v, lab) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<float>, label int").repartition(3)
    got = {r.vec_id: r for r in near_vectors.near_vectors(df).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.98) & (np.array(label)[:, None] == np.array(label)[None, :]) & ~np.eye(len(x), dtype=bool)
    want = links.sum(1)
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.98 * want.sum()
    label_of = np.arange(len(x))
    while True:
        low = np.where(links, label_of[None, :], len(x)).min(1)
        new = np.minimum(label_of, low)
        if (new == label_of).all():
            break
        label_of = new
    component = np.array([got[i].component_id for i in range(len(x))])
    assert (component >= label_of).all() and (component == label_of).mean() >= 0.98
    assert all(got[i].kept == (got[i].component_id == i) for i in got)


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    vectors = [(i, base[i % 60] + (0.02 * rng.normal(size=16) if i >= 60 else 0), i % 3 if i % 10 else None) for i in range(240)]
    data = [(i, [float(x) for x in v], lab, "clash") for i, v, lab in vectors] + [(900, None, 1, ""), (901, [0.0] * 16, 1, ""), (902, [float("nan")] * 16, 1, ""), (903, [1.0, 0.0], 1, ""), (904, [2.0, 0.0], 1, ""), (904, [2.0, 0.0], 1, "")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, node string").repartition(3)
    got = {r.vec_id: r.n_links for r in near_vectors.near_vectors(df).collect()}
    x = np.array([np.float32(v) for _, v, _ in vectors], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    labels = [lab for *_, lab in vectors]
    same = np.array([[a == b and a is not None for b in labels] for a in labels])
    links = (x @ x.T >= 0.98) & same & ~np.eye(len(x), dtype=bool)
    want = dict(enumerate(links.sum(1).tolist())) | {900: 0, 901: 0, 902: 0, 903: 2, 904: 2}
    assert all(got[i] <= n for i, n in want.items()) and sum(got.values()) >= 0.9 * sum(want.values())
    assert near_vectors.near_vectors(df.limit(0)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    out = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_licenses(spark, docs):
    mit = license_scan.TEMPLATES["MIT-text"]
    cut = " ".join(w for k, w in enumerate(mit.split(" ")) if k % 8)
    data = [(1, "x " + mit), (2, prose(50) + "\n# " + cut + " " + prose(30)), (3, "Released under the MIT License.\n" * 3), (4, "the license is released"), (5, None)]
    out = {(r.doc_id, r.license): (r.n_places, r.coverage) for r in license_scan.scan_licenses(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert out[1, "MIT-text"] == (1, 1.0) and 0.8 <= out[2, "MIT-text"][1] < 1 and out[3, "MIT"] == (3, 1.0) and not any(i in (4, 5) for i, _ in out)
    for _ in range(200):
        a, b = (R.choices("abcdefgh", k=R.randint(0, 12)) for _ in range(2))
        pairs = license_scan.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs) and len({j for _, j in pairs}) == len(pairs) == len({i for i, _ in pairs})
        assert [j for _, j in pairs] == sorted(j for _, j in pairs)


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(row[-1], last[j + 1]))
    return row[-1]


def test_alignment_of_gaps_is_a_longest_common_subsequence():
    for _ in range(300):
        a, b = (R.choices("abcdef", k=R.randint(0, 20)) for _ in range(2))
        pairs = license_scan._common(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and len(pairs) == longest_common(a, b)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))


def test_licenses_by_a_scan_of_whole_texts(spark):
    """Repeated, adjoining and edited notices, against windows at every word."""
    texts, want = [], {}
    for name in ("MIT-text", "ISC", "GPL-notice"):
        notice = license_scan.TEMPLATES[name].split(" ")
        for copies in (1, 2, 3):
            for edits in (0, 3):
                own = []
                for _ in range(copies):
                    w = list(notice)
                    for k in R.sample(range(2, len(w) - 2), edits):
                        w[k] = "changed"
                    own += w
                    if edits:
                        own += prose(R.randint(0, 30)).split()
                texts.append((name, " ".join([*prose(40).split(), *own, *prose(15).split()]), copies))
    rows = [(i, t, n) for i, (n, t, _) in enumerate(texts)]
    out = {(r.doc_id, r.license): r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, license string")).collect()}
    for i, (name, text, copies) in enumerate(texts):
        words, template = license_scan.license_words(text), license_scan.license_words(license_scan.TEMPLATES[name])
        n = len(template)
        span = 2 * n - int(0.8 * n)
        best = max((longest_common(template, words[a : a + span]), -a) for a in range(0, len(words)) if words[a] in template)
        r = out[i, name]
        assert r.n_places == copies and abs(r.coverage - best[0] / n) < 1e-9
        assert longest_common(template, words[r.first_word : r.last_word + 1]) == best[0]
    assert license_scan.scan_licenses(spark.createDataFrame([(1, "x " * 300_000 + license_scan.TEMPLATES["ISC"] + " y" * 300_000)], "doc_id long, text string")).count() == 1


def test_urls(spark):
    data = [(1, None), (2, "no host"), (3, "http://WWW.Example.ORG/es/x?q#f"), (4, "http://a.com/de/"), (5, "https://x.net/Cheap-Pills/1"), (6, "http://example.org/en/12"), (6, "http://example.org/en/12")]
    out = {r.page_id: (r.host, r.path, r["rule"], r.verdict) for r in url_filter.filter_urls(spark.createDataFrame(data, "page_id long, url string"), catalog.HOST_RULES + catalog.PATTERN_RULES).collect()}
    assert out == {1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("www.example.org", "/es/x", "example.org/es/", "block"), 4: ("a.com", "/de/", "com/de/", "block"), 5: ("x.net", "/Cheap-Pills/1", None, "block"), 6: ("example.org", "/en/12", "example.org/en/1", "block")}


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for out in (token_count.count_tokens(none, TOKENIZER), shard.shard_documents(none, catalog.SHARDS, catalog.GROWN), mix.mix_plan(none), packing.pack(none, TOKENIZER), near_texts.near_texts(none), quality.judged(none, labels), lm_score.score_documents(none), license_scan.scan_licenses(none)):
        assert out.count() == 0
