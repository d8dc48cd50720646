"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters by what it is (its vector, if training has met it in three texts) and by how
it is spelt (the scaled sum of hashed vectors of its character trigrams); a word of more
than 62 bytes enters as overlapping pieces of 20. Two recurrent layers read a window of
words from both sides, attention pools their states, and a logistic unit scores the
window. All overlapping windows of a text are scored; the text has the largest score.
Training knows labels of texts only: of each text the window that scores highest carries
the label.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append, lean, stored
from .decontaminate import words

WINDOW, STRIDE = 24, 12
_LONG, _PIECE = 62, 20
_GRAMS, _DIM, _HIDDEN = 1 << 15, 6, 8


def entries(text: str | None) -> list[bytes]:
    """Words of a text as the network reads them: one of more than 62 bytes is cut into pieces of at most 20 that share
    two bytes, so that each of its trigrams is in exactly one piece."""
    out = words(text)
    if max(map(len, out), default=0) > _LONG:
        out = [p for w in out for p in ([w] if len(w) <= _LONG else [w[i:i + _PIECE] for i in range(0, len(w) - 2, _PIECE - 2)])]
    return out


def trigrams(names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of words: the buckets of their character trigrams with the place of the word each is of.

    A word is marked at both ends.
    """
    marked = [b"^" + w + b"$" for w in names]
    text = np.frombuffer(b"".join(marked), dtype=np.uint8).astype(np.uint64)
    size = np.array([len(w) for w in marked], dtype=np.int64)
    of = np.repeat(np.arange(len(names)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(text))
    start = np.flatnonzero(left >= 3)
    mixed = (text[start] * np.uint64(0x9E3779B1) + text[start + 1] * np.uint64(0x85EBCA77C3) + text[start + 2] * np.uint64(0xC2B2AE3D27D4)) * np.uint64(0x9E3779B97F4A7C15)
    grams = (mixed >> np.uint64(40)).astype(np.int64) % _GRAMS
    return grams, of[start]


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Weights, forward pass, and backward pass."""

    def __init__(self, words: list[bytes], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.place = {w: i + 1 for i, w in enumerate(words)}  # place 0: all other words
        d, h = 2 * _DIM, _HIDDEN

        def normal(scale, *shape):
            return rng.normal(0, scale, shape).astype(np.float32)

        self.p = {
            "word": np.zeros((len(words) + 1, _DIM), dtype=np.float32), "gram": np.zeros((_GRAMS, _DIM), dtype=np.float32),
            **{f"{k}{s}": v for s in "fb" for k, v in (("in", normal(d**-0.5, d, 3 * h)), ("re", normal(h**-0.5, h, 3 * h)), ("bi", np.zeros(3 * h, dtype=np.float32)))},
            "att": normal(h**-0.5, 2 * h), "out": normal(h**-0.5, 2 * h), "bias": np.zeros(1, dtype=np.float32),
        }

    def places(self, names: list[bytes]) -> np.ndarray:
        return np.fromiter((self.place.get(w, 0) for w in names), dtype=np.int64, count=len(names))

    def vectors(self, ids: np.ndarray, grams: np.ndarray, of: np.ndarray, blank: bool = True) -> np.ndarray:
        """Input vectors of words; with blank, row 0 is the blank that fills short windows."""
        n = len(ids)
        count = np.bincount(of, minlength=n).astype(np.float32)
        chars = np.stack([np.bincount(of, self.p["gram"][grams, j], n) for j in range(_DIM)], 1) / np.sqrt(np.maximum(count, 1))[:, None]
        x = np.concatenate([self.p["word"][ids], chars.astype(np.float32)], 1)
        if blank:
            x[0] = 0
        return x

    def forward(self, x: np.ndarray, at: np.ndarray, keep: bool = False):
        """Outputs of windows at (rows of places in x, 0 where blank); with keep, also what the backward pass needs."""
        mask = (at > 0).astype(np.float32)
        n, length, h = len(at), at.shape[1], _HIDDEN
        states = np.empty((n, length, 2 * h), dtype=np.float32)
        tape = {}
        for side, steps in (("f", range(length)), ("b", range(length - 1, -1, -1))):
            g_all = (x @ self.p["in" + side] + self.p["bi" + side])[at]
            u = self.p["re" + side]
            s = np.zeros((n, h), dtype=np.float32)
            saved = []
            for t in steps:
                g, m = g_all[:, t], mask[:, t, None]
                zr = _sigmoid(g[:, :2 * h] + s @ u[:, :2 * h])
                z, r = zr[:, :h], zr[:, h:]
                q = s @ u[:, 2 * h:]
                c = np.tanh(g[:, 2 * h:] + r * q)
                new = s + m * (1 - z) * (c - s)
                if keep:
                    saved.append((t, s, z, r, q, c, m))
                s = new
                states[:, t, slice(0, h) if side == "f" else slice(h, 2 * h)] = s
            tape[side] = saved
        e = states @ self.p["att"] - 1e4 * (1 - mask)
        a = np.exp(e - e.max(1, keepdims=True))
        a /= a.sum(1, keepdims=True)
        pooled = np.einsum("nl,nld->nd", a, states)
        out = pooled @ self.p["out"] + self.p["bias"][0]
        return (out, (x, at, mask, states, a, pooled, tape)) if keep else out

    def backward(self, kept, slope: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the weights, and of x, for the slope of the loss in each output."""
        x, at, mask, states, a, pooled, tape = kept
        h = _HIDDEN
        d = {"out": pooled.T @ slope, "bias": np.array([slope.sum()])}
        d_pool = slope[:, None] * self.p["out"]
        d_a = np.einsum("nd,nld->nl", d_pool, states)
        d_e = a * (d_a - (a * d_a).sum(1, keepdims=True))
        d["att"] = np.einsum("nl,nld->d", d_e, states)
        d_states = a[:, :, None] * d_pool[:, None, :] + d_e[:, :, None] * self.p["att"]
        d_x = np.zeros_like(x)
        for side in "fb":
            u = self.p["re" + side]
            d_u, d_g = np.zeros_like(u), np.zeros((*at.shape, 3 * h), dtype=np.float32)
            carry = np.zeros((len(at), h), dtype=np.float32)
            part = slice(0, h) if side == "f" else slice(h, 2 * h)
            for t, s, z, r, q, c, m in reversed(tape[side]):
                d_new = carry + d_states[:, t, part]
                d_c = d_new * m * (1 - z) * (1 - c * c)
                d_z = -d_new * m * (c - s) * z * (1 - z)
                d_r = d_c * q * r * (1 - r)
                d_q = d_c * r
                d_zr = np.concatenate([d_z, d_r], 1)
                carry = d_new * (1 - m * (1 - z)) + d_zr @ u[:, :2 * h].T + d_q @ u[:, 2 * h:].T
                d_u[:, :2 * h] += s.T @ d_zr
                d_u[:, 2 * h:] += s.T @ d_q
                d_g[:, t] = np.concatenate([d_zr, d_c], 1)
            flat = d_g.reshape(-1, 3 * h)
            by_word = np.stack([np.bincount(at.ravel(), flat[:, j], len(x)) for j in range(3 * h)], 1).astype(np.float32)
            d["re" + side], d["bi" + side], d["in" + side] = d_u, flat.sum(0), x.T @ by_word
            d_x += by_word @ self.p["in" + side].T
        d_x[0] = 0
        return d, d_x


class Vocabulary(dict):
    """Words to their place; place 0 is the blank. Grows as words come."""

    def __init__(self):
        super().__init__()
        self.names: list[bytes] = [b""]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.names)
        self.names.append(word)
        return n


class Reader(Vocabulary):
    """A vocabulary that keeps the network's input vectors of its words; empties itself when it holds too many."""

    def __init__(self, net: Network, most: int = 1_000_000):
        super().__init__()
        self.net, self.most, self.x = net, most, np.zeros((1, 2 * _DIM), dtype=np.float32)

    def vectors(self) -> np.ndarray:
        n, known = len(self.names), self.done
        if n > known:
            if n > len(self.x):
                self.x = np.concatenate([self.x, np.zeros((max(n, 2 * len(self.x)) - len(self.x), self.x.shape[1]), dtype=np.float32)])
            self.x[known:n] = self.net.vectors(self.net.places(self.names[known:]), *trigrams(self.names[known:]), blank=known == 0)
            self.done = n
        return self.x

    done = 0

    def rest(self) -> None:
        """Between groups of texts: start again once full."""
        if len(self.names) > self.most:
            self.clear()
            self.names, self.done = [b""], 0


def windows(places: np.ndarray) -> np.ndarray:
    """All windows of a text, half overlapping, the last one filled with blanks; at least one."""
    n = max(1, -(-max(0, len(places) - WINDOW) // STRIDE) + 1)
    padded = np.zeros((n - 1) * STRIDE + WINDOW, dtype=np.int32)
    padded[:len(places)] = places
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


def score_texts(reader: Reader, texts: list[str | None], most: int = 8_192) -> np.ndarray:
    """Scores of whole texts: the largest over their windows, which go through the network in groups of at most about `most`."""
    best = np.full(len(texts), -np.inf)
    held: list[np.ndarray] = []
    owners: list[int] = []

    def flush() -> None:
        if held:
            x = reader.vectors()
            of = np.repeat(owners, [len(w) for w in held])
            flat = np.concatenate(held)
            for i in range(0, len(flat), most):
                used, at = np.unique(flat[i:i + most], return_inverse=True)
                if used[0]:
                    used, at = np.r_[0, used], at + 1
                np.maximum.at(best, of[i:i + most], reader.net.forward(x[used], at.reshape(-1, WINDOW)))
        held.clear()
        owners.clear()
        reader.rest()

    n = 0
    for i, text in enumerate(texts):
        w = windows(np.fromiter(map(reader.__getitem__, entries(text)), dtype=np.int32))
        held.append(w)
        owners.append(i)
        n += len(w)
        if n >= most:
            flush()
            n = 0
    flush()
    return 1 / (1 + np.exp(-np.clip(best, -30, 30)))


def fit(texts: list[str], toxic: np.ndarray, epochs: int = 12, rate: float = 4e-3, part: float = 0.2, seed: int = 11) -> Network:
    """The network fitted to texts and their labels; toxic ones have `part` of the weight."""
    rng = np.random.default_rng(seed)
    vocab = Vocabulary()
    docs = [np.fromiter(map(vocab.__getitem__, entries(t)), dtype=np.int32) for t in texts]
    y = np.asarray(toxic, dtype=np.float32)
    met = np.zeros((2, len(vocab.names)))
    for d, label in zip(docs, y, strict=True):
        met[int(label), np.unique(d)] += 1
    net = Network([w for w, n in zip(vocab.names, met.sum(0), strict=True) if n >= 3 and w], seed)
    if not docs or y.min() == y.max():
        net.p["out"][:] = 0
        net.p["bias"][0] = 0 if not docs else (4 if y[0] else -4)
        return net
    ids = net.places(vocab.names)
    grams, of = trigrams(vocab.names)
    begin = np.searchsorted(of, np.arange(len(ids) + 1))
    # First coordinates: smoothed log-odds of the word and of its trigrams, from which training goes on.
    n1, n0 = y.sum(), (1 - y).sum()
    seen = {"word": np.zeros((2, len(net.p["word"]))), "gram": np.zeros((2, _GRAMS))}
    for label in (0, 1):
        np.add.at(seen["word"][label], ids, met[label])
    for d, label in zip(docs, y, strict=True):
        d = np.unique(d)
        if len(d):
            seen["gram"][int(label), np.unique(np.concatenate([grams[begin[w]:begin[w + 1]] for w in d]))] += 1
    for table, n in seen.items():
        odds = np.log((n[1] + 0.3) / (n1 + 0.6)) - np.log((n[0] + 0.3) / (n0 + 0.6))
        net.p[table][:, 0] = np.clip(odds * np.sqrt(n.sum(0) / (n.sum(0) + 5)), -2, 6) / 2
    net.p["word"][0] = 0
    wins = [windows(d) for d in docs]
    owner = np.repeat(np.arange(len(docs)), [len(w) for w in wins])
    flat = np.concatenate(wins)
    first = np.r_[0, np.cumsum([len(w) for w in wins])[:-1]]
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    t = 0
    for epoch in range(epochs):
        if epoch % 2 == 0:
            x = net.vectors(ids, grams, of)
            out = np.concatenate([net.forward(x, flat[i:i + 8_192]) for i in range(0, len(flat), 8_192)])
            # the highest window of a toxic text; of another, the highest few and one at random
            top = [f + np.argsort(-out[f:f + len(w)])[: 1 if label else 4] for f, w, label in zip(first, wins, y, strict=True)]
            top += [np.flatnonzero(y[owner] == 0)[rng.permutation(np.count_nonzero(y[owner] == 0))[: len(docs)]]]
            mined = np.concatenate(top)
            n_mined = max(1, np.count_nonzero(y[owner[mined]] == 0))
        chosen = rng.permutation(mined)
        for i in range(0, len(chosen), 256):
            at = flat[chosen[i:i + 256]]
            label = y[owner[chosen[i:i + 256]]]
            used, back = np.unique(at, return_inverse=True)
            if used[0] != 0:
                used, back = np.r_[0, used], back + 1
            size = begin[used + 1] - begin[used]
            of_used = np.repeat(np.arange(len(used)), size)
            sel = np.arange(len(of_used)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin[used], size)
            x = net.vectors(ids[used], grams[sel], of_used)
            out_b, kept = net.forward(x, back.reshape(at.shape), keep=True)
            weight = np.where(label == 1, part / n1, (1 - part) / n_mined) * len(chosen)
            slope = (weight * (_sigmoid(out_b) - label) / len(at)).astype(np.float32)
            d, d_x = net.backward(kept, slope)
            d["word"] = np.stack([np.bincount(ids[used], d_x[:, j], len(net.p["word"])) for j in range(_DIM)], 1)
            d["word"][0] = 0
            share = d_x[:, _DIM:] / np.sqrt(np.maximum(np.bincount(of_used, minlength=len(used)), 1))[:, None]
            d["gram"] = np.stack([np.bincount(grams[sel], share[of_used, j], _GRAMS) for j in range(_DIM)], 1)
            t += 1
            for k, g in d.items():
                m[k] += 0.1 * (g - m[k])
                v2[k] += 0.01 * (g * g - v2[k])
                pace = rate / 4 if k in ("word", "gram") else rate
                net.p[k] = (net.p[k] - pace * (m[k] / (1 - 0.9**t)) / (np.sqrt(v2[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
    return net


def train(docs: DataFrame, labels: DataFrame, most: int = 1_500, longest: int = 40_000, seed: int = 11) -> Network:
    """The network for docs(doc_id, text) and labels(doc_id, toxic).

    It is fitted in one task to a bounded sample: up to `most` toxic and 3 * most other
    labelled texts of at most `longest` characters, those with the smallest hashes of
    doc_id and text; only its weights come to the driver. Null labels are dropped,
    repeated ones merged (the larger counts); of texts that share a doc_id the one with
    the smallest hash is taken.
    """
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("mark"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    texts = docs.where(F.length("text") <= longest).select("doc_id", F.xxhash64("text").alias("print"))
    first = texts.join(marks, "doc_id").groupBy("doc_id", "mark").agg(F.min("print").alias("print"))
    asked = first.where("mark = 1").orderBy(*order).limit(most).unionByName(first.where("mark = 0").orderBy(*order).limit(3 * most))
    asked = F.broadcast(stored(asked, "toxic-sample"))  # at most 4 * most ids
    picked = docs.select("doc_id", "text", F.xxhash64("text").alias("print")).where(F.length("text") <= longest).join(asked, ["doc_id", "print"])
    picked = picked.dropDuplicates(["doc_id", "print"]).select("doc_id", "print", "text", "mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["print"], r["doc_id"], r["text"], r["mark"]) for b in batches for r in b.to_pylist())
        net = fit([r[2] for r in rows], np.array([r[3] for r in rows]), seed=seed)
        yield pa.RecordBatch.from_pydict({"net": [pickle.dumps(net)]})

    made = picked.repartition(1).mapInArrow(lean(run), "net binary").first()  # None where no row was picked
    return pickle.loads(made["net"]) if made else fit([], np.array([]), seed=seed)


def toxicity(docs: DataFrame, labels: DataFrame, most: int = 1_500, seed: int = 11) -> DataFrame:
    """docs with `toxic_score` from 0 to 1, the largest over all windows of the whole text.

    A null or empty text scores as one blank window. Repeated rows each get their score;
    other columns stay, one called toxic_score is replaced; no rows give no rows. Without
    labels every score is 0.5.
    """
    docs = docs.drop("toxic_score")
    sent = docs.sparkSession.sparkContext.broadcast(train(docs.select("doc_id", "text"), labels, most, seed=seed))

    def scorer():
        reader = Reader(sent.value)
        return lambda texts: [score_texts(reader, texts)]

    return append(docs, ["text"], "toxic_score double", scorer)
