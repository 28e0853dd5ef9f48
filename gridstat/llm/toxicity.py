"""Operator 9: toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A document's words are cut into overlapping windows, every one of which is
scored. A word enters twice: as a learned vector of its own (words that few
sampled documents hold share one), and by its characters, which two gated
recurrent networks read in order, one in either direction. Two more such
networks read a window's words in either direction, attention weighs their
states, and the pooled state gives a logit. The document's logit is its windows'
largest, turned into a share of label 1 by logistic calibration on labelled
documents. Nothing else enters: no counts of labels, no word lists.

Learning takes at most about SAMPLE_EACH documents of either label, by a hash of
the id, and all of their windows. The sample is dealt over up to TRAIN_PARTS tasks;
in each epoch every task runs back-propagation (written out, with Adam) over its
own documents from the same weights, and the driver averages what they return:
iterative parameter mixing. Only weights pass through the driver. Scoring is
row-local over whole texts.

Defined results: null, empty and wordless texts have no window and get the
lowest score that calibration knows of; null labels and labels without a doc_id
teach nothing; with nothing to learn from, or no example of one label, every
score is the share of label 1 (0 if there is no row at all); a row without a
doc_id is scored, its held_out is null; words of more than PIECE characters are
read as several; extra columns are ignored.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstat.llm.common import below_share, crc_mod, discard, map_arrow, materialize, read_table, texts_of

SAMPLE_EACH = 2_500  # labelled documents of either label to learn from, about
STEPS, STRIDE = 48, 32  # words of a window, and from one window to the next
HIDDEN, VECTOR = 8, 8  # state of a direction over words; length of a word's own vector
CHAR_HIDDEN, CHAR_VECTOR = 8, 8  # the same over characters
CHARS = 1 << 10  # hashed characters
PIECE = 24  # characters of a step
VOCABULARY, WORD_DOCS = 20_000, 3  # words with a vector of their own, and sampled documents that hold one
TRAIN_PARTS, PART_DOCS = 8, 250  # tasks of an epoch at most, and documents a task at least
EPOCHS, MOST_EPOCHS, LEAST_UPDATES = 4, 10, 150  # epochs; more, while a small sample made few updates
ALL_WINDOWS, BATCH, RATE = 1, 128, 0.03  # epochs that take all windows of label 1; windows of an update
CACHED_WORDS = 300_000
SCORE_WINDOWS = 1024  # windows scored at once
THRESHOLD = 0.5
SEED = 11

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    words = _WORD.findall(text.lower())
    if max(map(len, words), default=0) <= PIECE:
        return words
    return [w[i : i + PIECE] for w in words for i in range(0, len(w), PIECE)]


def windows_of(n_words: int) -> list[int]:
    """Where windows begin: every word is in one, and neighbours overlap."""
    if not n_words:
        return []
    return [0, *range(STRIDE, n_words - STEPS + STRIDE, STRIDE)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


Weights = dict[str, np.ndarray]
#: Weights of which a batch touches some rows only.
SPARSE = ("word", "char")


def start_weights(n_words: int) -> Weights:
    """Vectors of words (the first: all others) and characters, two networks a level, attention and output."""
    rng, h, k = np.random.default_rng(SEED), HIDDEN, CHAR_HIDDEN
    draw = lambda *s, scale: rng.normal(0, scale, s).astype(np.float32)
    d = VECTOR + 2 * k
    return {
        "word": draw(n_words + 1, VECTOR, scale=0.1), "char": draw(CHARS, CHAR_VECTOR, scale=0.5),
        "char_w": draw(CHAR_VECTOR, 6 * k, scale=CHAR_VECTOR**-0.5), "char_b": np.zeros(6 * k, np.float32), "char_u": draw(2, k, 3 * k, scale=k**-0.5),
        "w": draw(d, 6 * h, scale=d**-0.5), "b": np.zeros(6 * h, np.float32), "u": draw(2, h, 3 * h, scale=h**-0.5),
        "attend": draw(2 * h, scale=h**-0.5), "out": draw(2 * h, scale=h**-0.5), "bias": np.array([-1.0], np.float32),
    }


def _gru(x: np.ndarray, u: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
    """States (steps, rows, size) over projected inputs, and what back-propagation needs. A masked step keeps the state."""
    h = len(u)
    s, states, tape = np.zeros((x.shape[1], h), x.dtype), np.empty((*x.shape[:2], h), x.dtype), []
    for i in range(len(x)):
        a = s @ u
        gates = _sigmoid(x[i, :, : 2 * h] + a[:, : 2 * h])
        r, z = gates[:, :h], gates[:, h:]
        c = np.tanh(x[i, :, 2 * h :] + r * a[:, 2 * h :])
        tape.append((s, a[:, 2 * h :], r, z, c))
        s = s + mask[i, :, None] * (1 - z) * (c - s)
        states[i] = s
    return states, tape


def _gru_back(d_states: np.ndarray, tape: list, u: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of the recurrent weights."""
    h = len(u)
    d_x, d_u, d_s = np.empty((*d_states.shape[:2], 3 * h), d_states.dtype), np.zeros_like(u), np.zeros_like(d_states[0])
    for i in range(len(tape) - 1, -1, -1):
        s, ac, r, z, c = tape[i]
        d_s = d_s + d_states[i]
        moved = d_s * mask[i, :, None]
        d_c = moved * (1 - z) * (1 - c * c)
        d_z = moved * (s - c) * z * (1 - z)
        d_r = d_c * ac * r * (1 - r)
        d_x[i] = np.hstack([d_r, d_z, d_c])
        d_rec = np.hstack([d_r, d_z, d_c * r])
        d_u += s.T @ d_rec
        d_s = d_s - moved * (1 - z) + d_rec @ u.T
    return d_x, d_u


def _scattered(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of rows of values by their place."""
    out = np.zeros((size, values.shape[1]), values.dtype)
    if len(at):
        order = np.argsort(at, kind="stable")
        own = at[order]
        first = np.flatnonzero(np.diff(own, prepend=own[0] - 1))
        out[own[first]] = np.add.reduceat(values[order], first)
    return out


def _groups(words: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words by length, so that few steps are padding: (their places, hashed characters (steps, words), mask)."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    every = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64) % CHARS
    begin, out, low = np.cumsum(lengths) - lengths, [], 0
    for high in (5, 8, 12, 16, PIECE):
        at = np.flatnonzero((lengths > low) & (lengths <= high))
        if len(at):
            steps = np.arange(lengths[at].max())[:, None]
            mask = steps < lengths[at]
            out.append((at, every[np.where(mask, begin[at] + steps, 0)], mask.astype(np.float32)))
        low = high
    return out


def _spelt(w: Weights, words: list[str]) -> tuple[np.ndarray, list]:
    """Vectors of words by their characters: the last states of both directions."""
    k, out, tapes = CHAR_HIDDEN, np.zeros((len(words), 2 * CHAR_HIDDEN), w["char_w"].dtype), []
    table = w["char"] @ w["char_w"] + w["char_b"]
    for at, codes, mask in _groups(words):
        both = []
        for d in range(2):
            c, m = (codes, mask) if d == 0 else (codes[::-1], mask[::-1])
            states, tape = _gru(table[:, 3 * k * d : 3 * k * (d + 1)][c], w["char_u"][d], m)
            out[at, k * d : k * (d + 1)] = states[-1]
            both.append((c, m, tape))
        tapes.append((at, both))
    return out, tapes


def _spelt_back(w: Weights, tapes: list, d_out: np.ndarray, g: Weights) -> None:
    k, d_table = CHAR_HIDDEN, np.zeros((CHARS, 6 * CHAR_HIDDEN), d_out.dtype)
    g["char_u"] = np.zeros_like(w["char_u"])
    for at, both in tapes:
        for d, (codes, mask, tape) in enumerate(both):
            d_states = np.zeros((*codes.shape, k), d_out.dtype)
            d_states[-1] = d_out[at, k * d : k * (d + 1)]
            d_x, d_u = _gru_back(d_states, tape, w["char_u"][d], mask)
            g["char_u"][d] += d_u
            d_table[:, 3 * k * d : 3 * k * (d + 1)] += _scattered(codes.ravel(), d_x.reshape(-1, 3 * k), CHARS)
    g["char"], g["char_w"], g["char_b"] = d_table @ w["char_w"].T, w["char"].T @ d_table, d_table.sum(axis=0)


def _forward(w: Weights, words: list[str], own: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Logits of windows given as places in a list of words (-1: padding), and what back-propagation needs."""
    h, mask = HIDDEN, (ids.T >= 0).astype(np.float32)
    spelt, tapes = _spelt(w, words)
    x = np.hstack([w["word"][own], spelt])
    steps = (x @ w["w"] + w["b"])[np.maximum(ids.T, 0)]
    forward, tape_f = _gru(steps[:, :, : 3 * h], w["u"][0], mask)
    backward, tape_b = _gru(steps[::-1, :, 3 * h :], w["u"][1], mask[::-1])
    states = np.concatenate([forward, backward[::-1]], axis=2)
    a = states @ w["attend"] + (mask - 1) * 1e4
    a = np.exp(a - a.max(axis=0))
    a /= a.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", a, states)
    return pooled @ w["out"] + w["bias"][0], (x, mask, tapes, states, tape_f, tape_b, a, pooled)


def gradients(w: Weights, words: list[str], own: np.ndarray, ids: np.ndarray, y: np.ndarray) -> tuple[float, Weights]:
    """Mean logistic loss and its gradients over windows of word places with labels y."""
    h = HIDDEN
    logits, (x, mask, tapes, states, tape_f, tape_b, a, pooled) = _forward(w, words, own, ids)
    p = _sigmoid(logits)
    loss = float(-(y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7)).mean())
    off = (p - y) / len(y)
    g = {"out": pooled.T @ off, "bias": np.array([off.sum()])}
    d_pooled = off[:, None] * w["out"]
    d_a = np.einsum("nh,tnh->tn", d_pooled, states)
    d_a = a * (d_a - (a * d_a).sum(axis=0))
    g["attend"] = np.einsum("tn,tnh->h", d_a, states)
    d_states = a[:, :, None] * d_pooled + d_a[:, :, None] * w["attend"]
    d_f, u_f = _gru_back(d_states[:, :, :h], tape_f, w["u"][0], mask)
    d_b, u_b = _gru_back(d_states[::-1, :, h:], tape_b, w["u"][1], mask[::-1])
    g["u"] = np.stack([u_f, u_b])
    d_steps = np.concatenate([d_f, d_b[::-1]], axis=2)
    used = ids.T >= 0
    d_projected = _scattered(ids.T[used], d_steps[used], len(words))
    g["w"], g["b"] = x.T @ d_projected, d_projected.sum(axis=0)
    d_x = d_projected @ w["w"].T
    g["word"] = _scattered(own, d_x[:, :VECTOR], len(w["word"]))
    _spelt_back(w, tapes, d_x[:, VECTOR:], g)
    return loss, g


@dataclass
class State:
    """Weights with Adam's moments and the number of steps so far."""

    w: Weights
    m: Weights
    v: Weights
    step: int = 0

    @classmethod
    def new(cls, n_words: int) -> State:
        w = start_weights(n_words)
        return cls(w, {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()})

    def copy(self) -> State:
        return State(*({k: x.copy() for k, x in part.items()} for part in (self.w, self.m, self.v)), self.step)

    def update(self, g: Weights, rate: float, touched: dict[str, np.ndarray]) -> None:
        """A step of Adam; of sparse weights, over the touched rows alone."""
        self.step += 1
        for k, grad in g.items():
            at = touched.get(k, slice(None))
            grad = np.clip(grad[at], -1, 1).astype(np.float32)
            self.m[k][at] = 0.9 * self.m[k][at] + 0.1 * grad
            self.v[k][at] = 0.99 * self.v[k][at] + 0.01 * grad * grad
            lean = self.m[k][at] / (1 - 0.9**self.step)
            self.w[k][at] -= rate * lean / (np.sqrt(self.v[k][at] / (1 - 0.99**self.step)) + 1e-6)


@dataclass
class Model:
    vocabulary: dict[str, int] = field(default_factory=dict)  # words with a vector of their own, from 1 on
    weights: Weights = field(default_factory=dict)
    slope: float = 1.0  # logistic calibration of documents' logits
    offset: float = 0.0
    constant: float | None = 0.0  # the score of everything, where nothing could be learned
    lowest: float = 0.0

    def own(self, words: list[str]) -> np.ndarray:
        return np.fromiter((self.vocabulary.get(x, 0) for x in words), dtype=np.int64, count=len(words))


def train_part(state: State, vocabulary: dict[str, int], docs: list[tuple[list[str], int]], epoch: int) -> tuple[State, dict[str, np.ndarray]]:
    """One epoch over a task's documents (words, label): the new state, and which rows of sparse weights it touched.

    All windows of documents of label 0 are examples of label 0. A document of
    label 1 need not be toxic in all its windows: in the first epochs all of them
    are examples, then the one with the largest logit of all.
    """
    state, model = state.copy(), Model(vocabulary)
    words = sorted({w for doc, _ in docs for w in doc})
    number, own = {w: i for i, w in enumerate(words)}, model.own(words)
    seen = {"word": np.zeros(len(state.w["word"]), bool), "char": np.zeros(CHARS, bool)}
    rows, owner = [], []
    for d, (doc, _) in enumerate(docs):
        place = np.array([number[w] for w in doc] + [-1] * STEPS, dtype=np.int32)
        for s in windows_of(len(doc)):
            row = place[s : s + STEPS].copy()
            row[max(0, len(doc) - s) :] = -1
            rows.append(row)
            owner.append(d)
    if not rows:
        return state, seen
    ids, owner, y = np.stack(rows), np.array(owner), np.array([label for _, label in docs])
    positive = np.flatnonzero(y[owner] == 1)
    if epoch >= ALL_WINDOWS and len(positive):
        logits = np.concatenate([_local_logits(state.w, words, own, ids[positive[i : i + 512]]) for i in range(0, len(positive), 512)])
        order = np.lexsort((logits, owner[positive]))
        last = np.flatnonzero(np.diff(owner[positive][order], append=-1))
        positive = positive[order[last]]
    chosen = np.concatenate([positive, np.flatnonzero(y[owner] == 0)])
    chosen = np.random.default_rng([SEED, epoch]).permutation(chosen)
    size = min(BATCH, max(16, len(chosen) // 16))  # some updates even of a small part
    for i in range(0, len(chosen), size):
        part = chosen[i : i + size]
        used, local = _used(ids[part])
        names = [words[k] for k in used]
        _, g = gradients(state.w, names, own[used], local, y[owner[part]].astype(np.float32))
        touched = {"word": np.unique(own[used]), "char": np.unique(np.concatenate([c.ravel() for _, c, _ in _groups(names)]))}
        for k, at in touched.items():
            seen[k][at] = True
        state.update(g, RATE * 0.8**epoch, touched)
    return state, seen


def _used(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words that windows use, windows as places among those)."""
    used, local = np.unique(ids, return_inverse=True)
    shift = int(used[0] < 0)
    return used[shift:], local.reshape(ids.shape) - shift


def _local_logits(w: Weights, words: list[str], own: np.ndarray, ids: np.ndarray) -> np.ndarray:
    used, local = _used(ids)
    return _forward(w, [words[k] for k in used], own[used], local)[0]


def mixed(states: list[tuple[State, dict[str, np.ndarray]]]) -> State:
    """The average of states: of sparse weights, each row's over the parts that touched it."""
    out = states[0][0].copy()
    for name in ("w", "m", "v"):
        for k in out.w:
            every = np.stack([getattr(s, name)[k] for s, _ in states])
            share = np.ones(len(states)) if k not in SPARSE else None
            if share is None:
                hit = np.stack([seen[k] for _, seen in states]).astype(np.float32)
                hit[:, hit.sum(axis=0) == 0] = 1
                getattr(out, name)[k] = ((every * hit[:, :, None]).sum(axis=0) / hit.sum(axis=0)[:, None]).astype(np.float32)
            else:
                getattr(out, name)[k] = every.mean(axis=0).astype(np.float32)
    out.step = max(s.step for s, _ in states)
    return out


class Scorer:
    """Largest window logits of documents; projected word inputs are cached in a bounded table.

    Both directions run as one batch, gate by gate, so that all arrays of a step
    are contiguous: a row of a gate's table is a word's input forward, the one
    CACHED_WORDS + 1 rows on its input backward. Signs and factors of the
    sigmoids and of tanh(x) = 2 / (1 + exp(-2x)) - 1 are in tables and weights.
    The last row of each half is padding, whose update gate keeps the state.
    """

    def __init__(self, model: Model):
        self.model = model
        self.at: dict[str, int] = {}
        h, rows = HIDDEN, CACHED_WORDS + 1
        self.factor = (-1.0, -1.0, -2.0)  # reset, update, candidate
        self.tables = [np.zeros((2 * rows, h), dtype=np.float32) for _ in range(3)]
        self.tables[1][[rows - 1, 2 * rows - 1]] = -1e4
        if model.weights:
            u = model.weights["u"]
            self.u = [np.ascontiguousarray(u[:, :, h * g : h * (g + 1)] * np.float32(f)) for g, f in enumerate(self.factor)]

    def _add(self, words: list[str]) -> None:
        """Give words rows of the tables; callers make room first."""
        w, h, rows = self.model.weights, HIDDEN, CACHED_WORDS + 1
        x = np.hstack([w["word"][self.model.own(words)], _spelt(w, words)[0]])
        made, begin = x @ w["w"] + w["b"], len(self.at)
        for d in range(2):
            for g, f in enumerate(self.factor):
                self.tables[g][rows * d + begin : rows * d + begin + len(words)] = made[:, 3 * h * d + h * g : 3 * h * d + h * (g + 1)] * np.float32(f)
        self.at.update(zip(words, range(begin, begin + len(words)), strict=True))

    def _numbers(self, words: list[str]) -> list[int]:
        at = self.at
        numbers = [at.get(w, -1) for w in words]
        if -1 in numbers:
            new = list(dict.fromkeys(w for w, i in zip(words, numbers, strict=True) if i < 0))
            if len(at) + len(new) > CACHED_WORDS:
                at.clear()
                new = list(dict.fromkeys(words))
            self._add(new)
            numbers = [at[w] for w in words]
        return numbers

    def logits(self, texts: list[str]) -> np.ndarray:
        """The largest logit of each text's windows; -inf without a word."""
        out = np.full(len(texts), -np.inf)
        parts: list[tuple[int, int, list[str]]] = []  # document, windows, their words
        n = 0
        for d, text in enumerate(texts):
            words = words_of(text)
            starts = windows_of(len(words))
            for i in range(0, len(starts), SCORE_WINDOWS):
                group = starts[i : i + SCORE_WINDOWS]
                parts.append((d, len(group), words[group[0] : group[-1] + STEPS]))
                n += len(group)
                if n >= SCORE_WINDOWS:
                    self._score(parts, out)
                    parts, n = [], 0
        self._score(parts, out)
        return out

    def _score(self, parts: list[tuple[int, int, list[str]]], out: np.ndarray) -> None:
        """Windows of some parts, together: unseen words of all are looked at once."""
        if not parts:
            return
        numbers = np.array(self._numbers([w for _, _, words in parts for w in words]))
        held, at = [], 0
        for _, n, words in parts:
            row = np.full(n * STRIDE + STEPS, CACHED_WORDS, dtype=np.int64)
            row[: len(words)] = numbers[at : at + len(words)]
            at += len(words)
            held.append(np.lib.stride_tricks.sliding_window_view(row, STEPS)[::STRIDE][:n])
        ids, owner = np.concatenate(held), np.repeat([d for d, _, _ in parts], [n for _, n, _ in parts])
        for i in range(0, len(ids), SCORE_WINDOWS):
            np.maximum.at(out, owner[i : i + SCORE_WINDOWS], self._window_logits(ids[i : i + SCORE_WINDOWS]))

    def _window_logits(self, ids: np.ndarray) -> np.ndarray:
        n, t, h = len(ids), STEPS, HIDDEN
        steps = np.ascontiguousarray(ids.T)
        both = np.concatenate([steps, steps[::-1] + CACHED_WORDS + 1], axis=1)
        forward, backward = np.empty((t, n, h), dtype=np.float32), np.empty((t, n, h), dtype=np.float32)
        s = np.zeros((2, n, h), dtype=np.float32)
        with np.errstate(over="ignore"):
            for i in range(t):
                reset, update, candidate = (table.take(both[i], axis=0).reshape(2, n, h) for table in self.tables)
                for gate, u in ((reset, self.u[0]), (update, self.u[1])):
                    gate += s @ u
                    np.exp(gate, out=gate)
                    gate += 1
                a = s @ self.u[2]
                a /= reset
                candidate += a
                np.exp(candidate, out=candidate)
                candidate += 1
                np.divide(2, candidate, out=candidate)
                candidate -= 1
                s -= candidate
                s /= update
                s += candidate
                forward[i], backward[t - 1 - i] = s[0], s[1]
        w = self.model.weights
        a = forward @ w["attend"][:h] + backward @ w["attend"][h:]
        a[steps == CACHED_WORDS] = -1e4
        np.exp(a - a.max(axis=0), out=a)
        a /= a.sum(axis=0)
        forward *= a[:, :, None]
        backward *= a[:, :, None]
        return forward.sum(axis=0) @ w["out"][:h] + backward.sum(axis=0) @ w["out"][h:] + w["bias"][0]

    def scores(self, texts: list[str]) -> np.ndarray:
        m = self.model
        if m.constant is not None:
            return np.full(len(texts), m.constant)
        logits = self.logits(texts)
        return np.where(np.isinf(logits), m.lowest, _sigmoid(m.slope * np.where(np.isinf(logits), 0.0, logits) + m.offset))


def _vocabulary(sample: DataFrame) -> dict[str, int]:
    """Words that enough sampled documents hold, the most frequent first, numbered from 1."""

    def task():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            seen = Counter(w for t in texts_of(batch) for w in set(words_of(t)))
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        return one

    counts = map_arrow(sample.select("text"), task, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= WORD_DOCS)
    return {r["word"]: i for i, r in enumerate(counts.orderBy(F.desc("n"), "word").limit(VOCABULARY).select("word").collect(), 1)}


def _epoch(dealt: DataFrame, state: State, vocabulary: dict[str, int], epoch: int) -> State:
    """One epoch over the parts, each a group of bounded size in a task of its own, and the average of their weights."""
    shared = dealt.sparkSession.sparkContext.broadcast((state, vocabulary))

    def run(group: pa.Table) -> pa.Table:
        rows = zip(*(group.column(c).to_pylist() for c in ("doc_id", "y", "text")), strict=True)
        docs = [(words_of(t or ""), y) for _, y, t in sorted(rows, key=lambda r: (r[0], r[1], r[2] or ""))]
        return pa.table({"state": pa.array([pickle.dumps(train_part(*shared.value, docs, epoch))], pa.binary())})

    states = [pickle.loads(bytes(r["state"])) for r in dealt.groupBy("part").applyInArrow(run, "state binary").collect()]
    shared.destroy()
    return mixed(states)


def parts_of(n_docs: int) -> int:
    """Tasks of an epoch: small samples are not torn up, or averages would blur what few documents show."""
    return min(TRAIN_PARTS, max(1, n_docs // PART_DOCS))


def part_of(doc_id: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(parts))


def goes_on(epoch: int, state: State) -> bool:
    """Whether another epoch follows."""
    return epoch < EPOCHS or (epoch < MOST_EPOCHS and state.step < LEAST_UPDATES)


def fit(docs: DataFrame, labels: DataFrame, sample_each: int = SAMPLE_EACH) -> Model:
    """Learn from documents and their labels (doc_id, label)."""
    labels = labels.where("label in (0, 1) and doc_id is not null").select("doc_id", F.col("label").cast("int").alias("y"))
    n = {0: 0, 1: 0} | {r["y"]: r["count"] for r in labels.groupBy("y").count().collect()}
    if not n[0] or not n[1]:
        return Model(constant=float(bool(n[1])))
    part, share = F.xxhash64("doc_id", F.lit("toxicity")), {k: min(1.0, sample_each / c) for k, c in n.items()}
    taken = labels.where(below_share(part, F.when(F.col("y") == 1, share[1]).otherwise(share[0])))
    # What no label takes needn't be dealt out.
    some = docs.where(below_share(part, F.lit(max(share.values()))))
    sample = materialize(some.select("doc_id", "text").join(taken, "doc_id"))
    found = {0: 0, 1: 0} | {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if not found[0] or not found[1]:
        return Model(constant=n[1] / (n[0] + n[1]))
    model = Model(_vocabulary(sample))
    state = State.new(len(model.vocabulary))
    dealt = sample.withColumn("part", part_of(F.col("doc_id"), parts_of(found[0] + found[1])))
    epoch = 0
    while goes_on(epoch, state):
        state, epoch = _epoch(dealt, state, model.vocabulary, epoch), epoch + 1
    model.weights, model.constant = state.w, None
    _calibrate(model, sample, n, found)
    discard(sample)
    return model


def _calibrate(model: Model, sample: DataFrame, n: dict[int, int], found: dict[int, int]) -> None:
    """Logistic regression of the label on the document's logit, rows weighed as they stand in all labels."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def task():
        scorer = Scorer(shared.value)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(1), pa.array(scorer.logits(texts_of(batch)))], names=["y", "logit"])

        return one

    rows = map_arrow(sample.select("text", "y"), task, "y int, logit double").collect()
    x = np.array([r["logit"] for r in rows if np.isfinite(r["logit"])])
    if not len(x):  # no sampled document has a word
        model.constant = n[1] / (n[0] + n[1])
        return
    y = np.array([r["y"] for r in rows if np.isfinite(r["logit"])], dtype=float)
    weight = np.where(y == 1, n[1] / found[1], n[0] / found[0])
    weight /= weight.sum()
    center, spread = float(np.average(x, weights=weight)), float(x.std() + 1e-6)
    x = (x - center) / spread
    a = np.array([1.0, 0.0])
    for _ in range(50):  # Newton steps, a little ridge on the slope
        p = _sigmoid(a[0] * x + a[1])
        g = np.array([(weight * (p - y) * x).sum() + 1e-4 * a[0], (weight * (p - y)).sum()])
        k = weight * p * (1 - p) + 1e-9
        hess = np.array([[(k * x * x).sum() + 1e-4, (k * x).sum()], [(k * x).sum(), k.sum()]])
        a = a - np.clip(np.linalg.solve(hess, g), -1, 1)
    model.slope, model.offset = float(a[0] / spread), float(a[1] - a[0] * center / spread)
    model.lowest = float(_sigmoid(np.array([model.slope * (x.min() * spread + center) + model.offset]))[0])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task():
        scorer = Scorer(shared.value)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer.scores(texts_of(batch)))], names=["doc_id", "score"])

        return one

    return map_arrow(docs.select("doc_id", "text"), task, "doc_id long, score double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all of `documents`."""
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0).select("doc_id", F.col("toxic").alias("label"))
    out = score(docs, fit(docs.where(crc_mod("doc_id", 5) != 0), labels))
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
