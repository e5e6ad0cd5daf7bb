"""The bits of running text, predicted from hashed contexts across words and mixed by gated weights that adapt along each document.

Every token has a code of CODE bits, a hash of its word. Its probability is that of these binary decisions, in turn:

* known: has the word a training count;
* for known words: each bit of the code; then, if the document holds a word of this code, whether it is the last such
  word again; then the word's share of the counts of its code, without those of the word that it is not;
* for unknown words: once the document holds one, whether it is one of them again; then that word's share of them, or
  else its spelling.

Each decision has five predictors in the logistic domain: the corpus (exact counts), the two hashed contexts of one and
two words before (counted over all training text), the document so far and the word that followed the last time the
word before stood there. A predictor without a say for a decision is 0 there. A gate picks the weights that mix them;
each document starts from START and moves its weights after each of its steps, of 16 tokens, then ever more up to 512.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from weftline.llm.wordhash import mix, occurrence

#: Bits of a word's code, words before it in each hashed context, bits of the size of their tables: a bound for what is broadcast.
CODE, WORDS_BEFORE, TABLE_BITS = 8, (1, 2), (20, 20)
NODES = 1 << CODE
#: Learning rate, tokens that the starting weights count as, smoothing of counts, most of a log odds.
RATE, PRIOR, PSEUDO, MOST = 0.7, 12.0, 1.0, 9.0
#: Places of a document at which its weights and counts move; beyond the last, after as many tokens again.
STEPS = (16, 48, 112, 240, 496, 1008)
LAST_STEP = 512
# The gates behind those of the code's bits (three for each, by the foreseen word: none, after a miss,
# after a hit), and the document's counters behind those of the code's nodes.
KNOWN, AGAIN, UNKNOWN_AGAIN, ALL_GATES = 3 * CODE, 3 * CODE + 3, 3 * CODE + 5, 3 * CODE + 6
DOC_KNOWN, DOC_UNKNOWN_AGAIN, COUNTERS = NODES, NODES + 1, NODES + 2


def _start() -> np.ndarray:
    """Starting weights by gate: corpus, one word, two words, document, foreseen word."""
    w = np.zeros((ALL_GATES, 5), np.float32)
    w[: 3 * CODE : 3] = (0.5, 0.4, 0.3, 0.4, 0.0)
    w[1 : 3 * CODE : 3] = (0.5, 0.4, 0.3, 0.4, 0.3)
    w[2 : 3 * CODE : 3] = (0.10, 0.10, 0.15, 0.10, 4.0)
    w[KNOWN : KNOWN + 3] = (0.8, 0.0, 0.0, 0.4, 0.3)
    w[KNOWN + 2, 4] = 3.0
    w[AGAIN] = (0.9, 0.0, 0.0, 0.3, 0.0)
    w[AGAIN + 1] = (0.3, 0.0, 0.0, 0.2, 3.5)
    w[UNKNOWN_AGAIN] = (0.5, 0.0, 0.0, 0.9, 1.0)
    return w


START = _start()


def odds(one: np.ndarray, zero: np.ndarray) -> np.ndarray:
    return np.clip(np.log((one + PSEUDO) / (zero + PSEUDO)), -MOST, MOST)


def contexts(word: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """For each token the hashes of the words before it; word holds a hash of each token, place its place in the document."""
    out, h = [], np.zeros(len(word), np.uint64)
    for back in range(1, max(WORDS_BEFORE) + 1):
        before = np.zeros(len(word), np.uint64)
        before[back:] = word[:-back].astype(np.uint64) + np.uint64(1)
        before[place < back] = 0  # before the document's first word
        h = mix(h + before + np.uint64(back))
        if back in WORDS_BEFORE:
            out.append(h)
    return out


def slots(context: np.ndarray, node: np.ndarray, size: int) -> np.ndarray:
    """The slot of a context's table for each token's node: the bits of the code so far behind a 1."""
    return (((context ^ (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - size)).astype(np.int64)


def bits(code: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each bit of the codes, highest first: its place, the node before it and its value."""
    for b in range(CODE):
        yield b, (1 << b) | (code >> (CODE - b)), ((code >> (CODE - 1 - b)) & 1)


def count_bits(tables: list[np.ndarray], word: np.ndarray, place: np.ndarray, counted: np.ndarray) -> None:
    """Adds the bits of the tokens that are counted to the tables, (2, slots) each: zeros and ones."""
    code = (word & np.uint32(NODES - 1)).astype(np.int64)[counted]
    held = [c[counted] for c in contexts(word, place)]
    for _, node, value in bits(code):
        for table, context, size in zip(tables, held, TABLE_BITS, strict=True):
            at = slots(context, node, size) + value * (1 << size)
            table += np.bincount(at, minlength=2 << size).reshape(table.shape).astype(table.dtype)


@dataclass
class Corpus:
    """Log odds of the two tables' slots and of the code's nodes, counts by code, and the share of unknown tokens.

    A word that one training token alone has was new there, so their share is that of new words to come (Good-Turing).
    """

    tables: list[np.ndarray]
    nodes: np.ndarray
    by_code: np.ndarray
    known: float

    @staticmethod
    def of(tables: list[np.ndarray], by_code: np.ndarray, once: int) -> Corpus:
        nodes = np.zeros(NODES, np.float32)
        for b in range(CODE):
            halves = by_code.reshape(1 << b, 2, -1).sum(2)
            nodes[1 << b : 2 << b] = odds(halves[:, 1], halves[:, 0])
        return Corpus([odds(t[1], t[0]).astype(np.float32) for t in tables], nodes, by_code, float(odds(by_code.sum() - once, once)))


@dataclass
class Seen:
    """What each token can know of its document: documents ascend, tokens are numbers of words."""

    place: np.ndarray
    foreseen: np.ndarray
    after_hit: np.ndarray
    last_of_code: np.ndarray

    @staticmethod
    def of(doc: np.ndarray, token: np.ndarray, code: np.ndarray, known: np.ndarray) -> Seen:
        n = len(token)
        index = np.arange(n)
        place = index - np.searchsorted(doc, doc)
        before = np.where(place > 0, index - 1, 0)
        follows = np.where(place > 0, _last(doc, token)[before], -1)
        foreseen = np.where(follows >= 0, token[np.minimum(follows + 1, n - 1)], -1)
        hit = foreseen == token
        of_code = _last(doc, np.where(known[token], code, NODES))
        return Seen(place, foreseen, (place > 0) & hit[before], np.where(of_code >= 0, token[of_code], -1))


def _last(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each row the last row before it of the same document and key, or -1."""
    order = np.lexsort((key, doc))
    same = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    out = np.full(len(key), -1)
    out[order[1:][same]] = order[:-1][same]
    return out


def _step_of(place: np.ndarray) -> np.ndarray:
    early = np.searchsorted(STEPS, place, "right")
    return np.where(place < STEPS[-1], early, len(STEPS) + (place - STEPS[-1]) // LAST_STEP)


class Step:
    """The decisions of one step of all documents: they are predicted with the weights and counters from before it.

    at are the step's tokens by document, row the documents' rows of weights and counters, more whether a document
    goes on after the step, so that it is worth learning from.
    """

    def __init__(self, at: np.ndarray, row: np.ndarray, more: np.ndarray, weights: np.ndarray, counters: np.ndarray, out: np.ndarray) -> None:
        self.at, self.out, self.more = at, out, more[at]
        new = np.diff(row[at], prepend=-1) != 0
        self.rows, self.local = row[at][new], np.cumsum(new) - 1
        self.weights, self.counters = weights[self.rows], counters[self.rows]

    def decide(self, which: np.ndarray, gate: int, gates: int, state: np.ndarray | int, x: list[np.ndarray | float], counter: np.ndarray | int, value: np.ndarray, foreseen: np.ndarray) -> None:
        """Adds the log probability of one decision of the tokens `which`, then learns from it; no later decision of the step has its gates or counters."""
        r = self.local[which]
        flat = self.counters.reshape(-1)
        place = (r * COUNTERS + counter) * 2
        inputs = np.zeros((5, len(which)), np.float32)
        for k, v in enumerate(x):
            inputs[k] = v
        inputs[3], inputs[4] = odds(flat[place + 1], flat[place]), foreseen
        of_gate = np.ascontiguousarray(self.weights[:, gate : gate + gates].reshape(-1, 5).T)
        g = r * gates + state
        z = np.zeros(len(which), np.float32)
        for k in range(5):
            z += of_gate[k][g] * inputs[k]
        side = np.where(value, np.float32(1), np.float32(-1))
        e = np.exp(-side * np.clip(z, -20, 20))  # odds against what came
        self.out[self.at[which]] -= np.log1p(e) * np.float32(1 / np.log(10))
        go = self.more[which]
        if go.any():
            if not go.all():
                g, place, inputs, side, e, value = g[go], place[go], inputs[:, go], side[go], e[go], value[go]
            wrong = side * (e / (1 + e))
            size = len(self.rows) * gates
            rate = RATE / (np.bincount(g, minlength=size) + PRIOR)
            moved = np.stack([np.bincount(g, wrong * v, size) * rate for v in inputs], 1)
            self.weights[:, gate : gate + gates] += moved.reshape(-1, gates, 5)
            np.add.at(flat, place + value, np.float32(1))

    def close(self, weights: np.ndarray, counters: np.ndarray) -> None:
        weights[self.rows], counters[self.rows] = self.weights, self.counters


def token_scores(doc: np.ndarray, token: np.ndarray, word: np.ndarray, c: np.ndarray, spelling: np.ndarray, corpus: Corpus) -> np.ndarray:
    """The log10 probability of each token.

    doc ascends; token numbers the words, of which word holds a 32-bit hash, c the training count and spelling the
    spelled log10 probability.
    """
    n = len(token)
    if not n:
        return np.zeros(0)
    known = c > 0
    codes = (word & np.uint32(NODES - 1)).astype(np.int64)
    seen = Seen.of(doc, token, codes[token], known)
    context = contexts(word[token], seen.place)
    new = ~known[token]
    earlier_new = np.zeros(n, np.int64)
    earlier_new[new] = occurrence(doc[new])
    earlier_same = np.zeros(n, np.int64)
    earlier_same[new] = occurrence(doc[new], token[new])
    step = _step_of(seen.place)
    more = step < step[np.searchsorted(doc, doc, "right") - 1]  # the document goes on after this step
    row = np.where(step[np.searchsorted(doc, doc, "right") - 1] > 0, doc - doc[0] + 1, 0)  # documents of one step share row 0, which never moves
    rows, row = np.unique(np.append(0, row), return_inverse=True)
    row = row[1:]
    weights = np.broadcast_to(START, (len(rows), *START.shape)).copy()
    counters = np.zeros((len(rows), COUNTERS, 2), np.float32)
    out = np.zeros(n)

    order = np.argsort(step, kind="stable")
    edges = np.flatnonzero(np.diff(step[order], prepend=-1, append=step.max() + 1))
    for a, b in zip(edges, edges[1:], strict=False):
        at = order[a:b]
        now = Step(at, row, more, weights, counters, out)
        decide = now.decide
        t, f = token[at], seen.foreseen[at]
        state = np.where(f >= 0, 1 + seen.after_hit[at], 0)
        f_known = np.where(f >= 0, known[np.maximum(f, 0)], False)
        decide(np.arange(len(at)), KNOWN, 3, state, [corpus.known], DOC_KNOWN, known[t], np.where(f >= 0, 2.0 * f_known - 1, 0))
        old = np.flatnonzero(known[t])
        code, f_code = codes[t[old]], np.where(f_known, codes[np.maximum(f, 0)], -1)[old]
        held = [h[at[old]] for h in context]
        agrees = f_code >= 0
        for bit, node, value in bits(code):
            hint = np.where(agrees, 2.0 * ((f_code >> (CODE - 1 - bit)) & 1) - 1, 0)
            x = [corpus.nodes[node], *(table[slots(h, node, size)] for table, h, size in zip(corpus.tables, held, TABLE_BITS, strict=True))]
            decide(old, 3 * bit, 3, np.where(agrees, state[old], 0), x, node, value, hint)
            agrees = agrees & (((f_code >> (CODE - 1 - bit)) & 1) == value)
        last = seen.last_of_code[at[old]]
        has = last >= 0
        again = has & (last == t[old])
        of_code = corpus.by_code[code].astype(float)
        its = np.where(has, c[np.maximum(last, 0)], 0)
        told = has & (last == f[old])
        x = odds(its, of_code - its)
        decide(old[has], AGAIN, 2, told[has].astype(int), [x[has]], 0, again[has], told[has])
        out[at[old][~again]] += np.log10(c[t[old][~again]] / (of_code - its)[~again])
        fresh = np.flatnonzero(~known[t])
        if len(fresh):
            n_new, n_same = earlier_new[at[fresh]], earlier_same[at[fresh]]
            may, repeated = n_new > 0, n_same > 0
            decide(fresh[may], UNKNOWN_AGAIN, 1, 0, [-1.0], DOC_UNKNOWN_AGAIN, repeated[may], ((f >= 0) & ~f_known)[fresh[may]])
            out[at[fresh[repeated]]] += np.log10(n_same[repeated] / n_new[repeated])
            out[at[fresh[~repeated]]] += spelling[t[fresh[~repeated]]]
        now.close(weights, counters)
    return out
