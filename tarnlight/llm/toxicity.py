"""Toxicity by a bidirectional gated recurrent network with attention pooling (Cho et al. 2014; Bahdanau et al. 2015).

Each word enters as a vector of its own and the mean vector of its character n-grams, so that unseen spellings of a word
still have a meaning. Two recurrent passes read a window of ``WINDOW`` words; attention weighs the states; a logistic unit
scores the window. Windows overlap and cover the whole text; a document scores as its worst window. The network is trained
in numpy, by one task, from a bounded sample of labelled documents: a toxic document teaches through its worst window
(multiple-instance learning), a clean one through its worst and a random one. Only the text is an input.
"""

from __future__ import annotations

import pickle
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlight.llm.select import unused
from tarnlight.llm.text import columns, freed, lower_words, pieces, utf8

WINDOW, STRIDE = 48, 36
WORD_DIM, CHAR_DIM, HIDDEN = 10, 10, 8
#: Bounds of the training sample in labelled documents, and of both vocabularies.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1600, 5000
#: And so many characters of text in all; a single text of more than a sixteenth of that isn't learned from.
SAMPLE_CHARS = 64_000_000
MAX_WORDS, MAX_GRAMS, MIN_DOCS = 20_000, 40_000, 4
#: Rounds, and steps of BATCH windows in each, whatever the sample's size.
ROUNDS, STEPS, BATCH, RATE, SEED = 6, 90, 128, 0.01, 20240131
#: Of every FOLDS documents, by crc32 of doc_id as text, one is held out and never learned from.
FOLDS = 5
SLOT_BITS = 18
_CHUNK = 1024


def grams(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All runs of four bytes of all words with marked ends, as 32-bit codes in order, and the word that each belongs to."""
    if not found:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    data = np.frombuffer(b"<" + b"><".join(found) + b">\0\0\0", np.uint8).astype(np.uint32)
    codes = data[:-3] | data[1:-2] << np.uint32(8) | data[2:-1] << np.uint32(16) | data[3:] << np.uint32(24)
    lengths = np.fromiter(map(len, found), np.int64, len(found)) + 2
    owner = np.repeat(np.arange(len(found), dtype=np.int32), lengths)
    inside = np.arange(len(owner)) + 4 <= np.cumsum(lengths)[owner]
    return codes[inside], owner[inside]


def _parts(found: list[bytes]) -> Iterator[list[bytes]]:
    """Some words at a time, so that their n-grams take bounded memory."""
    for at in range(0, len(found), _CHUNK * 32):
        yield found[at : at + _CHUNK * 32]


def windows(n: int) -> list[int]:
    """First words of the windows over ``n`` words; the last window ends with the text. No words: one empty window."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


@dataclass
class Inputs:
    numbers: np.ndarray
    flat: np.ndarray
    ends: np.ndarray

    def of(self, rows: np.ndarray) -> Inputs:
        counts = np.diff(self.ends)[rows]
        ends = np.concatenate([[0], np.cumsum(counts)])
        at = np.arange(ends[-1]) + np.repeat(self.ends[rows] - ends[:-1], counts)
        return Inputs(self.numbers[rows], self.flat[at], ends)


@dataclass
class Network:
    """Weights, and the numbers of known words and character n-grams (from 1; 0 is unknown and has a zero vector)."""

    words: dict[bytes, int]
    gram_codes: np.ndarray  # by slot: the one known n-gram of that slot, and its number
    gram_numbers: np.ndarray
    weights: dict[str, np.ndarray]

    def parts(self) -> tuple:
        """Plain values that make the network again, so that they can be sent where this package isn't installed."""
        return self.words, self.gram_codes, self.gram_numbers, self.weights

    def inputs(self, found: list[bytes]) -> Inputs:
        """What the words enter as: their numbers, and the known n-grams of all words with the ends of each word's."""
        known = self.words.get
        flat, counts = [np.empty(0, np.int32)], [np.zeros(1, np.int64)]
        for part in _parts(found):
            codes, owner = grams(part)
            slots = _slots(codes)
            numbers = np.where(self.gram_codes[slots] == codes, self.gram_numbers[slots], 0)
            flat.append(numbers[numbers > 0])
            counts.append(np.bincount(owner[numbers > 0], minlength=len(part)))
        words = np.fromiter((known(w, 0) for w in found), np.int32, len(found))
        return Inputs(words, np.concatenate(flat), np.cumsum(np.concatenate(counts)))

    def vectors(self, x: Inputs) -> np.ndarray:
        chars = np.zeros((len(x.numbers), CHAR_DIM), np.float32)
        counts = np.diff(x.ends)
        some = counts > 0
        if len(x.flat):
            chars[some] = np.add.reduceat(self.weights["C"][x.flat], x.ends[:-1][some], axis=0) / counts[some, None]
        return np.concatenate([self.weights["E"][x.numbers], chars], axis=1)

    def table(self, x: Inputs) -> np.ndarray:
        """Each word's input gates of both passes, made for some words at a time."""
        n = len(x.numbers)
        out = np.zeros((max(1, n), 6 * HIDDEN), np.float32)
        for at in range(0, n, _CHUNK * 32):
            ends = x.ends[at : at + _CHUNK * 32 + 1]
            part = Inputs(x.numbers[at : at + _CHUNK * 32], x.flat[ends[0] : ends[-1]], ends - ends[0])
            out[at : at + len(part.numbers)] = self.vectors(part) @ self.weights["W"] + self.weights["g"]
        return out


def _slots(codes: np.ndarray) -> np.ndarray:
    return (codes * np.uint32(2654435761)) >> np.uint32(32 - SLOT_BITS)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def _run(gates: np.ndarray, there: np.ndarray, u: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States of one pass. gates: (T, B, 3H) from the inputs; there: (T, B, 1), 0 past a window's end, where states stay."""
    steps, batch, _ = gates.shape
    h = np.zeros((batch, HIDDEN), np.float32)
    states, kept = np.empty((steps, batch, HIDDEN), np.float32), []
    for t in range(steps):
        zr = _sigmoid(gates[t, :, : 2 * HIDDEN] + h @ u[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = np.tanh(gates[t, :, 2 * HIDDEN :] + (r * h) @ u[:, 2 * HIDDEN :])
        new = h + there[t] * z * (c - h)
        if keep:
            kept.append((h, z, r, c))
        h = states[t] = new
    return states, kept


def _run_back(d_states: np.ndarray, kept: list, there: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the input gates and of ``u``."""
    steps, batch, _ = d_states.shape
    d_gates, d_u = np.empty((steps, batch, 3 * HIDDEN), np.float32), np.zeros_like(u)
    dh = np.zeros((batch, HIDDEN), np.float32)
    uz, ur, uc = u[:, :HIDDEN], u[:, HIDDEN : 2 * HIDDEN], u[:, 2 * HIDDEN :]
    for t in reversed(range(steps)):
        h, z, r, c = kept[t]
        dh = dh + d_states[t]
        moved = dh * there[t]
        da_z = moved * (c - h) * z * (1 - z)
        da_c = moved * z * (1 - c * c)
        d_rh = da_c @ uc.T
        da_r = d_rh * h * r * (1 - r)
        d_gates[t] = np.concatenate([da_z, da_r, da_c], axis=1)
        d_u[:, : 2 * HIDDEN] += h.T @ d_gates[t][:, : 2 * HIDDEN]
        d_u[:, 2 * HIDDEN :] += (r * h).T @ da_c
        dh = dh - moved * z + d_rh * r + da_z @ uz.T + da_r @ ur.T
    return d_gates, d_u


def _pool(states: np.ndarray, there: np.ndarray, w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Attention weights over time, the pooled state and the window's logit."""
    a = np.tanh(states @ w["A"]) @ w["a"]
    a = np.where(there[:, :, 0] > 0, a, -30.0)
    a = np.exp(a - a.max(axis=0))
    a /= a.sum(axis=0)
    pooled = (a[:, :, None] * states).sum(axis=0)
    return a, pooled, pooled @ w["o"] + w["b"]


def _gates(table: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Input gates of both passes, the backward one reversed in time. index: (B, T) rows of ``table``, -1 past the end."""
    steps = index.T
    there = (steps >= 0).astype(np.float32)[:, :, None]
    both = table[np.maximum(steps, 0)]
    return both[:, :, : 3 * HIDDEN], both[::-1, :, 3 * HIDDEN :], there


@dataclass
class Layout:
    """All windows of documents of word numbers: where each begins and ends in ``words``, and the document of each."""

    words: np.ndarray
    first: np.ndarray
    stop: np.ndarray
    owners: np.ndarray

    @classmethod
    def of(cls, documents: list[np.ndarray]) -> Layout:
        starts = [windows(len(numbers)) for numbers in documents]
        counts = [len(s) for s in starts]
        ends = np.cumsum([len(numbers) for numbers in documents], dtype=np.int64)
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        first = np.concatenate([np.empty(0, np.int64), *starts]).astype(np.int64) + np.repeat(begins, counts)
        stop = np.minimum(first + WINDOW, np.repeat(ends, counts))
        return cls(np.concatenate([*documents, [0]]).astype(np.int32), first, stop, np.repeat(np.arange(len(documents)), counts))

    def rows(self, which: np.ndarray | slice) -> np.ndarray:
        """These windows as rows of word numbers, -1 past a window's end."""
        at = self.first[which][:, None] + np.arange(WINDOW)
        return np.where(at < self.stop[which][:, None], self.words[np.minimum(at, len(self.words) - 1)], -1)


def _logits(net: Network, table: np.ndarray, layout: Layout) -> np.ndarray:
    """Logits of all windows; table: each word's input gates of both passes."""
    out = np.empty(len(layout.first), np.float32)
    w = net.weights
    for at in range(0, len(out), _CHUNK):
        part = layout.rows(slice(at, at + _CHUNK))
        part = part[:, : max(1, int((part >= 0).sum(axis=1).max()))]
        fore, back, there = _gates(table, part)
        f, _ = _run(fore, there, w["Uf"], False)
        b, _ = _run(back, there[::-1], w["Ub"], False)
        out[at : at + _CHUNK] = _pool(np.concatenate([f, b[::-1]], axis=2), there, w)[2]
    return out


def _numbered(texts: list[bytes]) -> tuple[list[bytes], list[np.ndarray]]:
    """Distinct words, and each text as numbers of them."""
    seen: dict[bytes, int] = defaultdict(count().__next__)
    number = seen.__getitem__
    out = [np.fromiter(map(number, lower_words(t)), np.int32) for t in texts]
    return list(seen), out


def logits(net: Network, texts: list[bytes]) -> np.ndarray:
    """The worst window's logit of each text, over all its windows."""
    found, documents = _numbered(texts)
    layout = Layout.of(documents)
    out = np.full(len(texts), -np.inf, np.float32)
    np.maximum.at(out, layout.owners, _logits(net, net.table(net.inputs(found)), layout))
    return out


def scores(net: Network, texts: list[bytes]) -> np.ndarray:
    x = logits(net, texts).astype(np.float64)
    return 1.0 / (1.0 + np.exp(-np.clip(net.weights["p"][0] * x + net.weights["p"][1], -700, 700)))


def _start(texts: list[bytes], rng: np.random.Generator) -> Network:
    """Vocabularies of what stands in MIN_DOCS training documents, and random weights."""
    in_docs: Counter[bytes] = Counter()
    for t in texts:
        in_docs.update(set(lower_words(t)))
    best = sorted(((n, w) for w, n in in_docs.items() if n >= MIN_DOCS), key=lambda x: (-x[0], x[1]))[:MAX_WORDS]
    words = {w: k + 1 for k, (_, w) in enumerate(best)}
    distinct, counts = np.empty(0, np.uint32), np.empty(0, np.float64)
    for part in _parts(sorted(in_docs)):
        codes, owner = grams(part)
        weights = np.array([in_docs[w] for w in part], np.float64)[owner]
        distinct, at = np.unique(np.concatenate([distinct, codes]), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate([counts, weights]), minlength=len(distinct))
    order = np.lexsort((distinct, -counts))
    order = order[counts[order] >= MIN_DOCS]
    _, first = np.unique(_slots(distinct[order]), return_index=True)  # a slot goes to its most frequent n-gram
    known = distinct[order[np.sort(first)[:MAX_GRAMS]]]
    gram_codes, gram_numbers = np.zeros(1 << SLOT_BITS, np.uint32), np.zeros(1 << SLOT_BITS, np.int32)
    gram_codes[_slots(known)], gram_numbers[_slots(known)] = known, np.arange(1, len(known) + 1)
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    size = WORD_DIM + CHAR_DIM
    w = {
        "E": draw(len(words) + 1, WORD_DIM, scale=0.1), "C": draw(len(known) + 1, CHAR_DIM, scale=0.1),
        "W": draw(size, 6 * HIDDEN, scale=size**-0.5), "g": np.zeros(6 * HIDDEN, np.float32),
        "Uf": draw(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5), "Ub": draw(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5),
        "A": draw(2 * HIDDEN, HIDDEN, scale=0.3), "a": draw(HIDDEN, scale=0.3),
        "o": draw(2 * HIDDEN, scale=0.3), "b": np.zeros(1, np.float32), "p": np.array([1.0, 0.0]),
    }
    w["E"][0] = w["C"][0] = 0
    return Network(words, gram_codes, gram_numbers, w)


class _Adam:
    def __init__(self, weights: dict[str, np.ndarray]):
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}
        self.t = 0

    def step(self, weights: dict[str, np.ndarray], grads: dict[str, tuple | np.ndarray], rate: float) -> None:
        """grads: arrays, or (rows, gradients of these rows) for embeddings."""
        self.t += 1
        scale = rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            at, g = g if isinstance(g, tuple) else (slice(None), g)
            self.m[k][at] = 0.9 * self.m[k][at] + 0.1 * g
            self.v[k][at] = 0.999 * self.v[k][at] + 0.001 * g * g
            weights[k][at] -= scale * self.m[k][at] / (np.sqrt(self.v[k][at]) + 1e-7)


def _summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, and the sum of the values of each."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    return rows[first], np.add.reduceat(values[order], first, axis=0) if len(first) else values


def gradients(net: Network, inputs: Inputs, index: np.ndarray, labels: np.ndarray, weight: np.ndarray, drop: np.ndarray | None = None) -> tuple[float, dict]:
    """Mean weighted log loss of windows and its gradients. index: rows of word numbers, -1 past the end."""
    w = net.weights
    used, at = np.unique(index[index >= 0], return_inverse=True)
    local = np.full(index.shape, -1, np.int64)
    local[index >= 0] = at
    part = inputs.of(used)
    if drop is not None:
        part.numbers = np.where(drop[: len(used)], 0, part.numbers)
    numbers, counts = part.numbers, np.diff(part.ends)
    x = net.vectors(part) if len(used) else np.zeros((1, WORD_DIM + CHAR_DIM), np.float32)
    table = x @ w["W"] + w["g"]
    fore, back, there = _gates(table, local)
    f, kept_f = _run(fore, there, w["Uf"], True)
    b, kept_b = _run(back, there[::-1], w["Ub"], True)
    states = np.concatenate([f, b[::-1]], axis=2)
    a, pooled, logit = _pool(states, there, w)
    p = _sigmoid(logit)
    total = weight.sum()
    loss = float((weight * (np.logaddexp(0, logit) - labels * logit)).sum() / total)
    d = (weight * (p - labels) / total).astype(np.float32)
    grads: dict = {"o": pooled.T @ d, "b": np.array([d.sum()], np.float32)}
    d_pooled = d[:, None] * w["o"]
    d_states = a[:, :, None] * d_pooled
    d_a = (states * d_pooled).sum(axis=2)
    d_a = a * (d_a - (a * d_a).sum(axis=0)) * (there[:, :, 0] > 0)
    inner = np.tanh(states @ w["A"])
    grads["a"] = (inner * d_a[:, :, None]).sum(axis=(0, 1))
    d_inner = d_a[:, :, None] * w["a"] * (1 - inner * inner)
    grads["A"] = np.tensordot(states, d_inner, ([0, 1], [0, 1]))
    d_states = d_states + d_inner @ w["A"].T
    gf, grads["Uf"] = _run_back(d_states[:, :, :HIDDEN], kept_f, there, w["Uf"])
    gb, grads["Ub"] = _run_back(d_states[::-1, :, HIDDEN:], kept_b, there[::-1], w["Ub"])
    both = np.concatenate([gf, gb[::-1]], axis=2) * there
    d_table = np.zeros_like(table)
    rows, values = _summed(np.maximum(local.T, 0).ravel(), both.reshape(-1, 6 * HIDDEN))
    d_table[rows] = values
    grads["W"], grads["g"] = x.T @ d_table, d_table.sum(axis=0)
    d_x = d_table @ w["W"].T
    if len(used):
        rows, values = _summed(numbers, d_x[:, :WORD_DIM])
        grads["E"] = (rows[rows > 0], values[rows > 0])
        owner = np.repeat(np.arange(len(used)), counts)
        grads["C"] = _summed(part.flat, (d_x[:, WORD_DIM:] / np.maximum(1, counts)[:, None])[owner])
    return loss, grads


def _calibrated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope and intercept of a logistic fit of document labels to worst-window logits, by Newton's steps."""
    ab = np.array([1.0, 0.0])
    data = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(data @ ab, -30, 30)))
        curve = data.T @ (data * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        ab = ab - np.linalg.solve(curve, data.T @ (p - y) + 1e-3 * (ab - [1.0, 0.0]))
    return ab if ab[0] > 0 else np.array([1.0, 0.0])


def train(texts: list[bytes], labels: list[int], seed: int = SEED) -> Network:
    """Fit the network. No texts, or one class only: a network that scores all texts by the share of toxic labels.

    Each round scores all windows of all texts and then learns from the worst of each text, and one more of each clean one.
    """
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    net = _start(texts, rng)
    if len(set(labels)) < 2:
        net.weights["o"][:] = 0
        net.weights["p"] = np.array([1.0, 4.0 if labels and labels[0] else -4.0])
        return net
    found, documents = _numbered(texts)
    layout = Layout.of(documents)
    owners = layout.owners
    starts = np.flatnonzero(np.diff(owners, prepend=-1))
    stops = np.append(starts[1:], len(owners))
    adam = _Adam(net.weights)
    inputs = net.inputs(found)
    pos = max(1.0, float(y.sum()))
    for round_ in range(ROUNDS):
        z = _logits(net, net.table(inputs), layout)
        noise = z + rng.normal(0, 1.0 if round_ == 0 else 0.1, len(z))
        worst = np.lexsort((-noise, owners))[starts]
        chosen, target = [worst], [y]
        clean = np.flatnonzero(y == 0)
        chosen.append(rng.integers(starts[clean], stops[clean]))
        target.append(np.zeros(len(clean), np.float32))
        if round_ == 0:  # before the network knows anything, more of each toxic document's windows
            toxic = np.flatnonzero(y[owners] == 1)
            chosen.append(rng.choice(toxic, min(len(toxic), int(2 * pos)), replace=False))
            target.append(np.ones(len(chosen[-1]), np.float32))
        chosen, target = np.concatenate(chosen), np.concatenate(target)
        times = -(-STEPS * BATCH // len(chosen))
        dealt = np.concatenate([rng.permutation(len(chosen)) for _ in range(times)])
        rate = RATE * (1.0 if round_ < ROUNDS - 2 else 0.3)
        for at in range(0, STEPS * BATCH, BATCH):
            part = dealt[at : at + BATCH]
            weight = np.where(target[part] == 1, 1.0, 0.7).astype(np.float32)
            drop = rng.random(BATCH * WINDOW) < 0.5  # words at times by their characters alone
            _, grads = gradients(net, inputs, layout.rows(chosen[part]), target[part], weight, drop)
            adam.step(net.weights, grads, rate)
    net.weights["p"] = _calibrated(logits(net, texts).astype(np.float64), y.astype(np.float64))
    return net


def remainder(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(h, doc_id, toxic, text)`` of at most SAMPLE_TOXIC and SAMPLE_CLEAN labelled documents, first by a hash of doc_id.

    Held-out documents, null labels and null texts are left out; of repeated labels the highest counts. In the same order,
    documents are taken while their texts have at most SAMPLE_CHARS characters together, so that one task can hold them.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(remainder(F.col("doc_id")) != 0).withColumn("h", F.xxhash64("doc_id"))
    pick = lambda toxic, n: known.where(F.col("toxic") == toxic).orderBy("h", "doc_id").limit(n)
    some = pick(1, SAMPLE_TOXIC).unionByName(pick(0, SAMPLE_CLEAN)).select("doc_id", "toxic", "h")
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(some), "doc_id")
    texts = texts.where(F.length("text") <= SAMPLE_CHARS // 16)
    upto = F.sum(F.length("text").cast("bigint")).over(Window.orderBy("h", "doc_id", "text"))  # of a bounded number of rows
    texts = texts.select("h", "doc_id", F.col("toxic").cast("int").alias("toxic"), "text")
    return texts.withColumn("upto", upto).where(F.col("upto") <= SAMPLE_CHARS).drop("upto")


def toxicity(text: Column | str, net: Network) -> Column:
    """The score of each whole text, 0 to 1. Null and empty texts get the score of a window without words."""
    held = SparkSession.active().sparkContext.broadcast(net.parts())

    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        here = Network(*held.value)
        for texts in batches:
            yield pa.array(np.concatenate([np.empty(0), *(scores(here, part) for part in pieces(texts))]), pa.float64())

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return freed(each(batches))

    return score.asNondeterministic()(text)


def fitted(docs: DataFrame, labels: DataFrame) -> Network:
    """The network, trained by one task on the bounded sample; the weights alone come to the driver."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for h, ids, toxic, texts in columns(batches, "h", "doc_id", "toxic", "text"):
            rows += zip(h.to_pylist(), ids.to_pylist(), toxic.to_pylist(), utf8(texts), strict=True)
        rows.sort()
        net = train([r[3] for r in rows], [r[2] for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net.parts())], pa.binary())], ["net"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return freed(each(batches))

    made = labelled_sample(docs, labels).repartition(1).mapInArrow(fit, "net binary").collect()
    return Network(*pickle.loads(bytes(made[0].net))) if made else train([], [])


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the documents that score ``threshold`` or more. Null and empty texts score as a window without words."""
    score = unused(docs, "_toxicity")
    scored = docs.withColumn(score, toxicity(F.col("text"), fitted(docs, labels)))
    return scored.where(F.col(score) < threshold).drop(score)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    net = fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = docs.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), toxicity("text", net).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
