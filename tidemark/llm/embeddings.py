"""Near-duplicate vectors by iterative quantisation, multi-index Hamming tables and an exact rerank.

Rotations of the principal directions are learned so that the signs of the rotated
coordinates are balanced and lose little: alternately the nearest signs and, by a singular
value decomposition, the rotation nearest to them. The code is cut into substrings, one
table each, wider ones for more vectors. How many tables there are is measured: pairs at
the threshold itself are made around the fitted sample, in directions at random and
towards other vectors, and rotations are added until as many of them meet as asked for; so vectors that
share a direction, whose signs differ more at the same cosine, get more tables. Vectors that
agree in some substring meet, and their cosine is taken from the original vectors in
double precision. A pair counts in the first table in which it meets. What a bucket gives
back is each vector's number of links and a spanning forest, never the list of its pairs;
a large bucket is split into pairs of blocks.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append, components, few, stored


class Code:
    """Signs of rotated coordinates, sign((x - centre) @ projection), as many as asked for; more rotations are learned when needed."""

    def __init__(self, sample: np.ndarray, centred: bool, rounds: int = 40, seed: int = 5):
        self.rng, self.rounds = np.random.default_rng(seed), rounds
        self.centre = sample.mean(0) if centred else np.zeros(sample.shape[1])
        z = sample - self.centre
        self.directions = np.linalg.eigh(z.T @ z / max(1, len(z)))[1]
        self.v = (z @ self.directions)[:4_096]
        self.parts: list[np.ndarray] = []

    def projection(self, bits: int) -> np.ndarray:
        d = self.directions.shape[1]
        while sum(p.shape[1] for p in self.parts) < bits:
            r = np.linalg.qr(self.rng.normal(size=(d, d)))[0]
            # the alternation has few fixed points on a small sample: later rotations stay as they were drawn
            for _ in range(self.rounds if len(self.parts) < 16 else 0):
                a, _, b = np.linalg.svd(np.where(self.v @ r >= 0, 1.0, -1.0).T @ self.v)
                r = (a @ b).T
            self.parts.append(self.directions @ r)
        return np.concatenate(self.parts, 1)[:, :bits]


def substrings(x: np.ndarray, model: tuple[np.ndarray, np.ndarray], tables: int) -> np.ndarray:
    """The code of each row, as one number for each table."""
    on = ((x - model[0]) @ model[1] >= 0).reshape(len(x), tables, -1)
    return on @ (1 << np.arange(on.shape[2], dtype=np.int64))


def widths_for(n: int) -> list[int]:
    """Bits of a substring to choose from for n different vectors: some 32 vectors for each value of the widest, 8 bits at least."""
    most = max(8, round(math.log2(n + 1)) - 5)
    return [w for w in (most - 6, most - 4, most - 2, most) if w >= 8]


def probes(sample: np.ndarray, threshold: float, most: int = 2_000, seed: int = 9) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of unit vectors at a cosine of exactly threshold, the hardest that count: around vectors of the sample at random, and towards others of it; and the sample's own pairs that are hardly above."""
    rng = np.random.default_rng(seed)
    x = sample[rng.permutation(len(sample))[:most]]
    x = x[rng.integers(0, len(x), max(most // 4, len(x)))]
    out = []
    for to in (rng.normal(size=x.shape), sample[rng.integers(0, len(sample), len(x))]):
        u = to - (to * x).sum(1, keepdims=True) * x
        size = np.linalg.norm(u, axis=1, keepdims=True)
        ok = size[:, 0] > 1e-6
        if ok.any():
            out.append((x[ok], threshold * x[ok] + math.sqrt(1 - threshold**2) * u[ok] / size[ok]))
    own = sample[:most]
    i, j = np.nonzero(np.triu((c := own @ own.T) >= threshold, 1) & (c < threshold + 0.2 * (1 - threshold)))
    if len(i) >= 50:
        out.append((own[i], own[j]))
    return out


def fitted(sample: np.ndarray, n: int, threshold: float, recall: float = 0.995, least: int = 4, row: int = 2_000) -> tuple[np.ndarray, np.ndarray, int, float]:
    """Centre, projection, number of tables and measured recall for n different vectors like the sample.

    Rotations are learned on one half of the sample and probed around the other (of a few
    vectors, drawn). For signs about 0 and about the mean, and for each width of a substring, the
    fewest tables are found in which a share `recall` of each kind of probes() meets. What
    costs least is taken: a vector in a table costs as much as `row` cosines, and the
    cosines it meets there, by the share of the sample's pairs that agree.
    """
    few_ = len(sample) < 64
    own, pairs = (sample, probes(sample, threshold)) if few_ else (sample[::2], probes(sample[1::2], threshold))
    best = None
    for centred in (False,) if few_ else (False, True):
        code = Code(own, centred, 0 if few_ else 40)
        for width in widths_for(n):
            tables = 8
            while best is None or tables * row < best[0]:
                model = code.centre, code.projection(tables * width)
                met = [np.logical_or.accumulate(substrings(a, model, tables) == substrings(b, model, tables), 1).mean(0) for a, b in pairs]
                worst = np.min(met, 0) if met else np.ones(tables)
                if worst[-1] < recall:
                    tables = math.ceil(tables * 1.5)
                    continue
                tables = max(least, int(np.argmax(worst >= recall)) + 1)
                keys = substrings(own[:2_000], model, len(worst))[:, :8].T
                sizes = np.concatenate([np.unique(k, return_counts=True)[1] for k in keys])
                together = (sizes * (sizes - 1)).sum() / max(1, len(keys) * keys.shape[1] * (keys.shape[1] - 1))
                cost = tables * (row + n * together)
                if best is None or cost < best[0]:
                    best = cost, code, width, tables, float(worst[tables - 1])
                break
    _, code, width, tables, reached = best
    return code.centre, code.projection(tables * width), tables, reached


def _unit(v) -> np.ndarray | None:
    """The vector in double precision at length 1; None if null, empty, zero or not finite."""
    if v is None or len(v) == 0:
        return None
    x = np.array([np.nan if c is None else c for c in v], dtype=np.float64)
    if not np.isfinite(x).all():
        return None
    most = np.abs(x).max()
    return x / most / np.linalg.norm(x / most) if most > 0 else None


def _links(threshold: float):
    """The function that takes the cosines of some small buckets of one table, or of one pair of blocks of a large bucket."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(pdf["x"]), dtype=np.float64).reshape(len(pdf), -1)
        keys = np.frombuffer(b"".join(pdf["keys"]), dtype=np.int64).reshape(len(pdf), -1)
        node, copies, side = pdf["node"].to_numpy(), pdf["copies"].to_numpy(), pdf["side"].to_numpy()
        table, cross = int(pdf["table"].iloc[0]), pdf["cross"].iloc[0]
        ids, degrees, edges = [], [], []
        order = np.argsort(keys[:, table], kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(keys[order, table])) + 1):
            linked = x[rows] @ x[rows].T >= threshold
            if cross or len(np.unique(side[rows])) > 1:
                linked &= side[rows, None] != side[None, rows]
            else:
                np.fill_diagonal(linked, False)
            if not linked.any():
                continue
            for t in range(table):  # met there already
                linked &= keys[rows, t, None] != keys[None, rows, t]
            degree = linked @ copies[rows]
            some = np.flatnonzero(degree)
            ids.append(node[rows[some]])
            degrees += degree[some].tolist()
            todo = np.ones(len(rows), dtype=bool)
            for s in some:
                if not todo[s]:
                    continue
                todo[s] = False
                front = [s]
                while front:
                    i = front.pop()
                    new = np.flatnonzero(linked[i] & todo)
                    todo[new] = False
                    edges += [(node[rows[i]], node[rows[j]]) for j in new]
                    front += new.tolist()
        a = [i for own in ids for i in own] + [e[0] for e in edges]
        b = [None] * len(degrees) + [e[1] for e in edges]
        n = pd.array(degrees + [None] * len(edges), dtype="Int64")
        return pd.DataFrame({"a": a, "b": b, "n": n})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.995, sample: int = 20_000, block: int = 2_048) -> DataFrame:
    """vectors(vec_id, embedding) with n_links, component_id and kept (vec_id = component_id).

    n_links: other rows with a cosine of at least threshold; component_id: the smallest
    vec_id that links reach. Vectors meet among those of their length. The rotations of a
    length are fitted, in one task, on some `sample` of its vectors (those of smallest hash, a bounded
    sample), with as many tables as find a share `recall` of pairs at the threshold itself;
    every vector is indexed. A model for each length comes to the driver. Vectors that
    are null, empty, zero or not finite link with nothing. Equal vectors are one
    until the end, told apart by 128 bits; repeated rows link with each other. Links in a
    component further apart than the tables find may be missed, none is made up. Buckets
    over `block` vectors are split. Other columns are dropped; no rows give no rows.
    """
    spark = vectors.sparkSession

    def read(embeddings: list) -> tuple[list, list, list]:
        units = [_unit(v) for v in embeddings]
        return (
            [None if u is None else len(u) for u in units],
            [None if u is None else hashlib.blake2b(u.tobytes(), digest_size=16).digest() for u in units],
            [None if u is None else u.tobytes() for u in units],
        )

    rows = stored(append(vectors.select("vec_id", "embedding"), ["embedding"], "d long, node binary, x binary", lambda: read, ("embedding",)), "vectors")
    different = stored(rows.where("node is not null").groupBy("d", "node").agg(F.count("*").alias("copies"), F.first("x").alias("x")), "vectors-different")
    lengths = different.groupBy("d").agg(F.count("*").alias("n")).where("n > 1")
    # a hash under its share of the range: about `sample` vectors of a length, the same ones on every run
    share = F.pmod(F.xxhash64("node"), F.lit(1 << 40)) * F.col("n") <= F.lit(sample * (1 << 40))
    picked = different.join(F.broadcast(lengths), "d").where(share).select("d", "n", "node", "x")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        x = np.frombuffer(b"".join(pdf["x"]), dtype=np.float64).reshape(len(pdf), -1)
        return pd.DataFrame({"d": [pdf["d"].iloc[0]], "model": [pickle.dumps(fitted(x, int(pdf["n"].iloc[0]), threshold, recall))]})

    made = picked.groupBy("d").applyInPandas(fit, "d long, model binary").collect()
    models = {r["d"]: ((m := pickle.loads(r["model"]))[:2], m[2]) for r in made}
    sent = spark.sparkContext.broadcast(models)

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d, part in pdf.groupby("d"):
                keys = np.zeros((len(part), 1), dtype=np.int64)
                if d in sent.value:  # a vector alone of its length has no one to meet
                    keys = substrings(np.stack([np.frombuffer(b, dtype=np.float64) for b in part["x"]]), *sent.value[d])
                yield part.assign(keys=[k.tobytes() for k in keys], at=list(keys))

    coded = stored(different.mapInPandas(code, "d long, node binary, copies long, x binary, keys binary, at array<long>"), "vectors-coded")
    met = coded.select("d", F.posexplode("at").alias("table", "key"))
    sizes = met.groupBy("d", "table", "key").agg(F.count("*").alias("size"))
    sizes = stored(sizes.where("size > 1"), "vectors-buckets")
    large = sizes.where(F.col("size") > block).select("d", "table", "key", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    bunches = coded.count() // block + 1
    placed = (
        coded.select("d", "node", "copies", "x", "keys", F.posexplode("at").alias("table", "key"))
        .join(few(sizes.select("d", "table", "key"), 500_000), ["d", "table", "key"], "left_semi")
        .join(few(large), ["d", "table", "key"], "left")
        .withColumn("side", F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
        .withColumns({"low": F.least("side", "other"), "high": F.greatest("side", "other")})
        .withColumn("cross", F.col("low") < F.col("high"))
        # small buckets go to the tasks' function some together: about `block` vectors of one table
        .withColumn("bunch", F.when(F.col("blocks").isNull(), F.pmod(F.xxhash64("key"), F.lit(bunches))).otherwise(F.col("key") + bunches))
    )
    found = stored(
        placed.groupBy("d", "table", "bunch", "low", "high").applyInPandas(_links(threshold), "a binary, b binary, n long"), "vectors-links"
    )
    degree = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("degree"))
    roots = components(found.where("b is not null").select("a", "b"))
    own = (
        rows.select("vec_id", "node").join(different.select("node", "copies"), "node", "left").join(degree, "node", "left").join(roots, "node", "left")
        .select("vec_id", F.coalesce("root", "node").alias("root"), (F.coalesce("degree", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"))
    )
    own = stored(own, "vectors-roots")
    least = own.where("root is not null").groupBy("root").agg(F.min("vec_id").alias("least"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    return own.join(few(stored(least, "vectors-least"), 500_000), "root", "left").select(
        "vec_id", "n_links", F.coalesce("least", "vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.coalesce("least", "vec_id"), F.lit(False)).alias("kept")
    )
