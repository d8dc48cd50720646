"""Quality by positive-unlabelled learning.

The learner sees trusted positives and unlabelled web text, never negatives. It minimises
the non-negative unbiased risk

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

over a small network on features of the whole text. The class prior comes from the data:
the least ratio, over score thresholds, of the shares of unlabelled and positive rows
above it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, append, stored

_CLASSES = 14
#: Class of each byte: lower, upper, digit, blank, line end, sentence punctuation, brackets, quotes, bars, signs, marks, ...
_CLASS = np.full(256, 13, dtype=np.int64)
for _i, _chars in enumerate((
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\v\f", b"\r\n", b".", b",;:", b"!?", b"()[]{}<>",
    b"'\"`", b"|/\\_-+=~", b"#$%&*@^",
)):
    _CLASS[list(_chars)] = _i
_CLASS[128:] = 12
N_FEATURES = _CLASSES * _CLASSES + _CLASSES + 9


def features(text: str | None) -> np.ndarray:
    """Features of a whole text: shares of byte classes and their pairs, repetition, lengths. A null text is empty."""
    raw = (text or "").encode()
    out = np.zeros(N_FEATURES, dtype=np.float32)
    if not raw:
        return out
    c = _CLASS[np.frombuffer(raw, dtype=np.uint8)]
    n = len(c)
    pairs = np.bincount(c[:-1] * _CLASSES + c[1:], minlength=_CLASSES * _CLASSES)
    out[: _CLASSES * _CLASSES] = np.sqrt(pairs / n)
    out[_CLASSES * _CLASSES: _CLASSES * (_CLASSES + 1)] = np.sqrt(np.bincount(c, minlength=_CLASSES) / n)
    words = raw.translate(LOWER).split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    m = max(1, len(words))
    distinct = len(set(words))
    same = np.count_nonzero(c[1:] == c[:-1])
    # Distinct words fall with length by itself: the second measure allows for it.
    out[-9:] = (
        np.log1p(n), np.log1p(m), n / m / 10, distinct / m, np.log1p(distinct) / np.log1p(m),
        len(set(lines)) / max(1, len(lines)), np.log1p(len(lines)), n / max(1, len(lines)) / 500, same / n,
    )
    return out


class Network:
    """One hidden layer; forward and backward passes in numpy, weights by Adam."""

    def __init__(self, n: int, hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        self.w = [rng.normal(0, 1 / np.sqrt(n), (n, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        self.mean = self.sd = None
        self.m, self.v, self.t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0

    def scale(self, x: np.ndarray) -> None:
        self.mean, self.sd = x.mean(0), x.std(0) + 1e-3

    def raw(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.clip((x - self.mean) / self.sd, -6, 6)
        h = np.tanh(x @ self.w[0] + self.w[1])
        return x, h, h @ self.w[2] + self.w[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x)[2], -30, 30)))

    def step(self, x: np.ndarray, h: np.ndarray, g: np.ndarray, rate: float, decay: float) -> None:
        """One Adam step; g: the risk's slope in each row's output."""
        gh = g[:, None] * self.w[2] * (1 - h * h)
        grads = [x.T @ gh + decay * self.w[0], gh.sum(0), h.T @ g + decay * self.w[2], np.array([g.sum()])]
        self.t += 1
        for i, d in enumerate(grads):
            self.m[i] += 0.1 * (d - self.m[i])
            self.v[i] += 0.001 * (d * d - self.v[i])
            self.w[i] = self.w[i] - rate * (self.m[i] / (1 - 0.9**self.t)) / (np.sqrt(self.v[i] / (1 - 0.999**self.t)) + 1e-8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 40, batch: int = 512, hidden: int = 24, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> Network:
    """The network of least non-negative risk under logistic loss; features are scaled by the unlabelled rows."""
    rng = np.random.default_rng(seed)
    net = Network(positive.shape[1], hidden, seed)
    net.scale(unlabelled)
    steps = max(1, len(unlabelled) // batch)
    for _ in range(epochs):
        u_parts = np.array_split(rng.permutation(len(unlabelled)), steps)
        p_parts = np.array_split(rng.permutation(len(positive)), min(steps, len(positive)))
        for i, u in enumerate(u_parts):
            p = p_parts[i % len(p_parts)]
            x, h, out = net.raw(np.concatenate([positive[p], unlabelled[u]]))
            s = _sigmoid(out)
            op, ou = out[:len(p)], out[len(p):]
            negative = np.logaddexp(0, ou).mean() - prior * np.logaddexp(0, op).mean()
            g_plus = np.r_[prior * (s[:len(p)] - 1) / len(p), np.zeros(len(u))]
            g_minus = np.r_[-prior * s[:len(p)] / len(p), s[len(p):] / len(u)]
            # Where the estimated risk on negatives is under zero, that part is undone instead of lowered further.
            g = g_plus + g_minus if negative >= 0 else -g_minus
            net.step(x, h, g, rate, decay)
    return net


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 7) -> float:
    """Share of positives among the unlabelled: a positive-against-unlabelled classifier is fitted on one half, and on the other
    the ratio of the shares above a threshold is taken where its upper bound is least."""
    def half(x, odd):
        return x[np.arange(len(x)) % 2 == odd]

    net = fit(half(positive, 0), half(unlabelled, 0), 0.5, epochs=15, seed=seed)
    p, u = np.sort(net.score(half(positive, 1))), np.sort(net.score(half(unlabelled, 1)))
    if not len(p) or not len(u):
        return 0.5
    at = np.quantile(p, np.linspace(0, 0.9, 60))
    above_p, above_u = 1 - np.searchsorted(p, at) / len(p), 1 - np.searchsorted(u, at) / len(u)
    bound = (above_u + np.sqrt(np.log(80) / 2 / len(u)) + np.sqrt(np.log(80) / 2 / len(p))) / above_p
    i = int(np.argmin(bound))
    return float(np.clip(above_u[i] / above_p[i], 0.05, 0.97))


def quality(docs: DataFrame, labels: DataFrame, most_positive: int = 8_000, most_unlabelled: int = 16_000, seed: int = 7) -> DataFrame:
    """docs(doc_id, text) with a score from 0 to 1, higher for better text.

    labels(doc_id, quality): rows of quality 1 are the trusted positives; documents
    without a label are the unlabelled text. Training takes the most_positive and
    most_unlabelled rows with the smallest hashes of doc_id, a bounded sample, in one task;
    only the weights come to the driver. Scoring takes every row. Null texts score as
    empty ones, repeated rows each get their score (of rows that share a doc_id, training
    takes the one whose features hash least), labels that are null or repeated are dropped
    or merged (the larger counts); without any positive or unlabelled row every score is
    0.5. Other columns are dropped.
    """
    x = append(docs.select("doc_id", "text"), ["text"], "x binary", lambda: lambda texts: [[features(t).tobytes() for t in texts]], ("text",))
    x = stored(x, "quality-features")
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("mark"))
    # ids and hashes are shuffled to pick the sample, the features are not
    ids = x.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.xxhash64("x")).alias("print")).join(marks, "doc_id", "left")
    order = [F.xxhash64("doc_id"), "doc_id"]
    asked = ids.where("mark = 1").orderBy(*order).limit(most_positive).unionByName(ids.where("mark is null").orderBy(*order).limit(most_unlabelled))
    asked = F.broadcast(stored(asked, "quality-sample"))  # at most most_positive + most_unlabelled ids
    picked = x.withColumn("print", F.xxhash64("x")).join(asked, ["doc_id", "print"]).dropDuplicates(["doc_id", "print"]).select("doc_id", "mark", "x")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["doc_id"], r["mark"] == 1, r["x"]) for b in batches for r in b.to_pylist())
        p, u = (np.frombuffer(b"".join(r[2] for r in rows if r[1] == m), dtype=np.float32).reshape(-1, N_FEATURES) for m in (True, False))
        net = fit(p, u, estimate_prior(p, u, seed), seed=seed) if len(p) and len(u) else None
        yield pa.RecordBatch.from_pydict({"net": [pickle.dumps(net)]})

    made = picked.repartition(1).mapInArrow(train, "net binary").first()  # None where no row was picked
    net = pickle.loads(made["net"]) if made else None
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def scorer():
        def score(rows: list[bytes]) -> list[np.ndarray]:
            own = np.frombuffer(b"".join(rows), dtype=np.float32).reshape(-1, N_FEATURES)
            return [sent.value.score(own) if sent.value and len(own) else np.full(len(rows), 0.5)]

        return score

    return append(x, ["x"], "score double", scorer, ("x",))
