"""N-gram Jaccard join: documents whose sets of word n-grams are similar, exactly and without a list of all pairs.

Take the incidence matrix of documents by n-grams; the overlaps are its product with its
own transpose. Rows of sizes a and b with overlap o are similar when o >= t (a + b - o).
So o is at least t * max(a, b), sizes further apart than t never link, and under any
common order of the columns two similar rows meet in the first a - ceil(t a) + 1 of either.

1. Equal rows become one.
2. Contraction: rows that share a min-hash column go to blocks of bounded size, in which
   the product is taken whole. A block gives back a spanning forest of its links, so
   what it emits is linear in its rows; groups of near copies become components here.
3. Columns in which more than a few components meet (passages that many texts share) go
   to the end of the order; this changes the work and not the result. The short prefixes
   of all rows are dealt out by blocks of columns, packed. Two similar rows meet in a
   column before that end, or share none before it: then what each has before it is at
   most (1 - t) / t of what it shares, and rows with more are not paired at the end, nor
   are those whose parities over parts of the columns differ too often.
4. Pairs of rows of different components that meet, less those whose sizes or counts rule
   them out, get their exact overlaps. Their links and the forests make the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append, components, few, lean, LOWER, stored

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd numbers by which the words of a shingle are told apart by place; more come for wider shingles.
def _places(width: int) -> np.ndarray:
    return _mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: list[str | None], width: int = 5, together: int = 1 << 20) -> list[np.ndarray]:
    """Of each text, the sorted distinct 64-bit hashes of its runs of `width` words; of a shorter one, of all its words; none without words.

    Words are runs without space, tab or line breaks, A-Z lower-cased. Many texts go at
    once: with running sums of byte * P^place modulo 2^64, a word's hash is a difference
    of two sums times P^-start, and a shingle's is a mixed sum of its words' by place.
    """
    out: list[np.ndarray] = []
    held, size = [], 0
    for t in texts:
        raw = t.encode() if t else b""
        held.append(raw)
        size += len(raw) + 1
        if size >= together:
            out += _sets(held, width)
            held, size = [], 0
    return out + _sets(held, width) if held else out


def _sets(raws: list[bytes], width: int) -> list[np.ndarray]:
    raw = np.frombuffer(b"\n".join(raws).translate(LOWER), dtype=np.uint8)
    inside = np.r_[False, ~_BLANK[raw], False]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    n = len(raw)
    if n > len(_powers[0]):
        _grow(n)
    power, inverse = _powers
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    word = (sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * _P
    word ^= word >> np.uint64(29)
    places = _places(width)
    full = np.zeros(max(0, len(word) - width + 1), dtype=np.uint64)
    for j in range(width):
        full += word[j:j + len(full)] * places[j]
    full = _mix(full)
    # first word of each text
    first = np.searchsorted(start, np.cumsum([0] + [len(r) + 1 for r in raws]))
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            x = np.sort(full[a:b - width + 1])
            out.append(x[np.r_[True, x[1:] != x[:-1]]])
        else:
            out.append(_mix((word[a:b] * places[:b - a]).sum(keepdims=True)) if b > a else np.zeros(0, dtype=np.uint64))
    return out


_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _grow(n: int) -> None:
    n = max(n, 1 << 17)
    for i, p in enumerate((_P, _P_INVERSE)):
        x = np.full(n, p, dtype=np.uint64)
        x[0] = 1
        _powers[i] = np.cumprod(x)


def _min_columns(x: np.ndarray, seeds: tuple[int, ...]) -> list[int]:
    """Min-hash of a set for each seed."""
    return [int(_mix(x ^ _mix(np.array([s], dtype=np.uint64))).min().astype(np.int64)) for s in seeds]


def _identity(x: np.ndarray) -> int:
    """64 bits that stand for a set."""
    with np.errstate(over="ignore"):
        return int(_mix(np.array([_mix(x + np.uint64(1)).sum() + np.uint64(len(x))], dtype=np.uint64)).astype(np.int64)[0])


def depth(n):
    """How many columns of their prefixes similar sets of which the smaller has n must share."""
    return 1 + n // 20


def least(n, num: int, den: int):
    """The least overlap of a set of n with a similar one."""
    return -(-num * n // den)


def parities(x: np.ndarray) -> np.ndarray:
    """512 bits: of each of as many parts of all columns, whether the set has an odd number there. Sets differ in at least as many columns as their bits do."""
    bits = np.bincount((_mix(x) >> np.uint64(55)).astype(np.int64), minlength=512) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def prefix(x: np.ndarray, crowds: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The columns of a set (before the end of the order, at it) in which it meets similar ones, and how many it has before.

    crowds: how many meet in each column at the end, 0 before it; the end goes by them.
    Of least(n) shared columns, the l-th in the order has at most n - least(n) + l before
    it and with it; l goes to depth(n), and to 1 at the end.
    """
    n, before = len(x), crowds == 0
    r = np.count_nonzero(before)
    over = n - least(n, num, den)
    end = x[~before][np.argsort(crowds[~before], kind="stable")][:over - r + 1] if r <= over else x[:0]
    return x[before][:over + depth(n)], end, r


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def forest(sets: list[np.ndarray], num: int, den: int, wide: int = 1024) -> list[tuple[int, int]]:
    """A spanning forest of the links among a block's rows: overlaps by products over `wide` columns at a time."""
    n = len(sets)
    size = np.array([len(x) for x in sets], dtype=np.int64)
    row = np.repeat(np.arange(n), size)
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    kept = count[col] > 1  # a column of one row adds to no overlap
    row, col = row[kept], col[kept]
    names, col = np.unique(col, return_inverse=True)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    overlap = np.zeros((n, n), dtype=np.float32)
    cuts = np.searchsorted(col, np.arange(0, len(names) + wide, wide))
    for k in range(len(cuts) - 1):
        r, c = row[cuts[k]:cuts[k + 1]], col[cuts[k]:cuts[k + 1]] - k * wide
        here, at = np.unique(r, return_inverse=True)
        part = np.zeros((len(here), wide), dtype=np.float32)
        part[at, c] = 1
        overlap[np.ix_(here, here)] += part @ part.T
    linked = den * overlap >= num * (size[:, None] + size[None, :] - overlap) - 1e-3
    trees, edges = _Forest(n), []
    # Breadth first over the link matrix: each row is met once.
    todo = np.ones(n, dtype=bool)
    for s in range(n):
        if not todo[s]:
            continue
        todo[s] = False
        front = [s]
        while front:
            i = front.pop()
            new = np.flatnonzero(linked[i] & todo)
            todo[new] = False
            edges += [(i, int(j)) for j in new if trees.join(i, int(j))]
            front += new.tolist()
    return edges


def join(docs: DataFrame, num: int = 75, den: int = 100, width: int = 5, **parameters) -> DataFrame:
    """docs(doc_id, text) with n_shingles and component_id: the smallest doc_id that links reach, its own included.

    Two texts link when den * intersection >= num * union of their sets of word n-grams.
    Empty and null texts have empty sets and link with nothing, not even each other.
    Repeated rows are texts of their own (and link if they have words); a null doc_id
    takes part and never names a component, unless nothing else can; other columns are
    dropped; no rows give no rows.
    """
    of = _components(docs.select("doc_id", "text"), num, den, width, **parameters)[1]
    least = of.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    return of.join(_small(stored(least, "jaccard-least")), "root", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, num: int = 75, den: int = 100, width: int = 5, **parameters) -> DataFrame:
    """The rows of docs of which each component keeps one: the one with the smallest doc_id, of repeated rows any one.

    Rows with empty texts all stay. Same columns as docs, whatever they are called.
    """
    rest = F.struct(*[c for c in docs.columns if c != "text"]).alias("rest")
    texts, of = _components(docs.select("doc_id", "text", rest), num, den, width, **parameters)
    kept = of.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("first"), F.count("*").alias("rows"))
    others = of.join(_small(stored(kept.where("rows > 1"), "jaccard-kept")), "root").where("row <> first.row").select("row")
    return texts.join(_small(stored(others, "jaccard-others")), "row", "left_anti").select(*["text" if c == "text" else f"rest.`{c}`" for c in docs.columns])


def _components(docs: DataFrame, num: int, den: int, width: int, block: int = 1_024, crowd: int = 12, wide: int = 8_192, seeds: tuple[int, ...] = (1, 2, 3)) -> tuple[DataFrame, DataFrame]:
    """The stored rows of docs, numbered, and for each (doc_id, row, n_shingles, root): root names its component, null for empty sets."""
    spark = docs.sparkSession

    def sets(texts: list[str | None]) -> tuple:
        out = [(len(x), _identity(x), _min_columns(x, seeds)) if len(x) else (0, None, None) for x in shingle_sets(texts, width)]
        return tuple(zip(*out, strict=True)) or ((), (), ())

    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    texts = stored(append(numbered, ["text"], "n long, node long, keys array<long>", lambda: sets), "jaccard-rows")
    info = texts.select("doc_id", "row", "n", "node", "keys")
    nodes = info.where("node is not null").groupBy("node").agg(F.min("row").alias("row"), F.min("n").alias("n"), F.first("keys").alias("keys"))
    nodes = stored(nodes, "jaccard-nodes")  # one row of the matrix for each different set
    again = info.join(nodes.select("node", F.col("row").alias("first")), "node").where("row <> first").select("row")
    only = texts.where("node is not null").select("row", "node", "text").join(_small(stored(again, "jaccard-copies")), "row", "left_anti")

    # Contraction
    slots = nodes.select("node", "row", F.posexplode("keys").alias("slot", "key"))
    groups = slots.groupBy("slot", "key").agg(F.count("*").alias("size")).where("size > 1")
    dealt = slots.join(groups, ["slot", "key"]).select(
        "row", F.concat_ws("-", "slot", "key", F.pmod(F.xxhash64("node", "slot"), F.ceil(F.col("size") / block))).alias("block")
    )
    dealt = stored(dealt.groupBy("row").agg(F.collect_list("block").alias("blocks")), "jaccard-blocks")  # at most one for each seed

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = shingle_sets(pdf["text"], width)
        names = pdf["node"].to_numpy()
        return pd.DataFrame([(names[i], names[j]) for i, j in forest(sets, num, den)], columns=["a", "b"], dtype="int64")

    edges = stored(
        texts.select("row", "node", "text").join(_small(dealt), "row").select("node", "text", F.explode("blocks").alias("block"))
        .groupBy("block").applyInPandas(lean(product), "a long, b long"), "jaccard-forest",
    )
    roots = stored(components(edges), "jaccard-roots")

    # Column prefixes, by blocks of columns
    tagged = only.join(_small(roots.withColumnRenamed("root", "comp")), "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), "text")
    entries = nodes.agg(F.sum(F.expr(f"n * {den - num} div {den} + 1"))).first()[0] or 0
    bits = max(4, int(entries // 1_000_000).bit_length() + 2)
    late = _crowded(tagged, bits, crowd, width)
    near = _meetings(tagged, late, bits, num, den, width, wide).groupBy("a", "b").agg(F.sum("n").alias("shared"), F.max("need").alias("need"))
    near = near.where("shared >= need").select("a", "b")
    near = stored(near, "jaccard-pairs")
    links = _verified(near, only, num, den, width)
    roots = components(edges.unionByName(links))

    of = info.join(roots, "node", "left").select("doc_id", "row", F.col("n").alias("n_shingles"), F.coalesce("root", "node").alias("root"))
    return texts, stored(of, "jaccard-components")


def _small(df: DataFrame) -> DataFrame:
    """A stored table of short rows: broadcast up to half a million rows, else Spark shuffles both sides."""
    return few(df, 500_000)


#: Entries of a block: the column's bits below the block's, and the component; then sizes of the row, whole and before the end of the order; the row;
#: for columns at the end the row's parities, its first columns there that come before this one, and the side it is on where the column is split.
_FIRST = 6
_NOTHING = np.uint64(0xFFFFFFFFFFFFFFFF)
_ENTRY = np.dtype([("col", "<u4"), ("comp", "<u8"), ("n", "<u4"), ("r", "<u4")])
_NAMED = np.dtype([*_ENTRY.descr, ("node", "<u8")])
_LATE = np.dtype([*_NAMED.descr, ("odd", "<u8", (8,)), ("first", "<u8", (_FIRST,)), ("side", "<u4")])


def _short(x: np.ndarray, bits: int) -> np.ndarray:
    """The first bits + 32 bits of columns. Columns that agree in them count as one until the exact overlaps."""
    return x >> np.uint64(32 - bits)


def _portions(sets: list[np.ndarray], most: int = 2_000_000) -> Iterator[slice]:
    """Runs of sets with about `most` columns together."""
    begin = size = 0
    for i, x in enumerate(sets):
        size += len(x)
        if size >= most:
            yield slice(begin, i + 1)
            begin, size = i + 1, 0
    if begin < len(sets):
        yield slice(begin, len(sets))


def _crowded(tagged: DataFrame, bits: int, crowd: int, width: int, most: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Short columns in which more than about `crowd` components meet, sorted, and how many do; at most the `most` most crowded (they only order the columns)."""
    one = np.dtype([("col", "<u4"), ("n", "u1")])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets, comps = shingle_sets(pdf["text"], width), pdf["comp"].to_numpy().astype(np.uint64)
            for own in _portions(sets):
                col = _short(np.concatenate(sets[own]), bits)
                comp = np.repeat(comps[own], [len(x) for x in sets[own]])
                order = np.argsort(col)
                col, comp = col[order], comp[order]
                first = np.flatnonzero(np.r_[True, col[1:] != col[:-1]]) if len(col) else np.zeros(0, dtype=np.int64)
                size = np.diff(np.r_[first, len(col)])
                n = np.ones(len(first), dtype=np.int64)
                again = np.repeat(size > 1, size)  # most columns are met once: only the others are sorted by component
                if again.any():
                    c, k = col[again], comp[again]
                    order = np.lexsort((k, c))
                    c, k = c[order], k[order]
                    new = np.r_[True, c[1:] != c[:-1]]
                    n[size > 1] = np.add.reduceat((new | np.r_[True, k[1:] != k[:-1]]).astype(np.int64), np.flatnonzero(new))
                table = np.empty(len(first), dtype=one)
                table["col"] = col[first] & np.uint64(0xFFFFFFFF)
                table["n"] = np.minimum(n, 255)
                block = (col[first] >> np.uint64(32)).astype(np.int64)
                cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else []
                yield pd.DataFrame([(int(block[s]), table[s:e].tobytes()) for s, e in zip(cut, [*cut[1:], len(table)], strict=True)], columns=["block", "ones"])

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        table = np.concatenate([np.frombuffer(b, dtype=one) for b in pdf["ones"]])
        table = table[np.argsort(table["col"], kind="stable")]
        start = np.flatnonzero(np.r_[True, table["col"][1:] != table["col"][:-1]])
        n = np.add.reduceat(table["n"].astype(np.int64), start)
        col = (np.int64(pdf["block"].iloc[0]) << 32) + table["col"][start].astype(np.int64)
        return pd.DataFrame({"col": col[n > crowd], "n": n[n > crowd]})

    found = tagged.mapInPandas(lean(count), "block long, ones binary").groupBy("block").applyInPandas(lean(total), "col long, n long")
    rows = np.array(found.orderBy(F.desc("n"), "col").limit(most).collect(), dtype=np.int64).reshape(-1, 2)
    rows = rows[np.argsort(rows[:, 0].astype(np.uint64))]
    return rows[:, 0].astype(np.uint64), rows[:, 1]


def _packed(tagged: DataFrame, late: tuple[np.ndarray, np.ndarray], bits: int, num: int, den: int, width: int, wide: int) -> DataFrame:
    """The prefixes' entries, one row for each portion and block of columns; the node is left out where it names its component.

    A column at the end in which more than `wide` components meet is dealt to tasks of its
    own: its entries have sides, of about `wide` components each, and a task (`part`) has two
    sides or one.
    """
    sent = tagged.sparkSession.sparkContext.broadcast(late)

    def crowds(x: np.ndarray) -> np.ndarray:
        cols, n = sent.value
        if not len(cols):
            return np.zeros(len(x), dtype=np.int64)
        x = _short(x, bits)
        at = np.minimum(np.searchsorted(cols, x), len(cols) - 1)
        return np.where(cols[at] == x, n[at], 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets, comps, nodes = shingle_sets(pdf["text"], width), pdf["comp"].to_numpy().astype(np.uint64), pdf["node"].to_numpy().astype(np.uint64)
            for own in _portions(sets):
                parts = [prefix(x, crowds(x), num, den) for x in sets[own]]
                before, after = [len(p[0]) for p in parts], [len(p[1]) for p in parts]
                size = [b + a for b, a in zip(before, after, strict=True)]
                col = _short(np.concatenate([y for p in parts for y in p[:2]]), bits)
                table = np.empty(len(col), dtype=_NAMED)
                table["col"] = col & np.uint64(0xFFFFFFFF)
                table["comp"], table["node"] = np.repeat(comps[own], size), np.repeat(nodes[own], size)
                table["n"], table["r"] = np.repeat([len(x) for x in sets[own]], size), np.repeat([p[2] for p in parts], size)
                late = np.repeat(np.tile([False, True], len(parts)), np.array([before, after]).T.ravel())
                of = np.repeat(np.arange(len(parts)), size)
                odd = {i: parities(sets[own][i]) for i, a in enumerate(after) if a}
                firsts = {i: np.r_[_short(parts[i][1][:_FIRST], bits), np.full(_FIRST, _NOTHING)][:_FIRST] for i in odd}
                rank = np.concatenate([np.r_[np.zeros(b, dtype=np.int64), np.arange(a)] for b, a in zip(before, after, strict=True)]) if parts else np.zeros(0, dtype=np.int64)
                block = (col >> np.uint64(32)).astype(np.int64)
                order = np.argsort(block, kind="stable")
                block, table, late, of, rank, col = block[order], table[order], late[order], of[order], rank[order], col[order]
                cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else []
                out = []
                for s, e in zip(cut, [*cut[1:], len(table)], strict=True):
                    part, at_end = table[s:e], late[s:e]
                    alone = ~at_end & (part["comp"] == part["node"])
                    ended = np.empty(np.count_nonzero(at_end), dtype=_LATE)
                    sides = np.ones(len(ended), dtype=np.int64)
                    if len(ended):
                        _copy(part[at_end], ended, _NAMED.names)
                        ended["odd"] = np.stack([odd[i] for i in of[s:e][at_end]])
                        ended["first"] = np.where(np.arange(_FIRST) < rank[s:e][at_end][:, None], np.stack([firsts[i] for i in of[s:e][at_end]]), _NOTHING)
                        cols, n = sent.value
                        sides = -(-n[np.searchsorted(cols, col[s:e][at_end])] // wide)
                        ended["side"] = _mix(ended["node"]) % sides.astype(np.uint64)
                    bare = np.empty(np.count_nonzero(alone), dtype=_ENTRY)
                    _copy(part[alone], bare, _ENTRY.names)
                    out.append((int(block[s]), "", bare.tobytes(), part[~alone & ~at_end].tobytes(), ended[sides == 1].tobytes()))
                    for c in np.unique(ended["col"][sides > 1]):
                        here = ended["col"] == c
                        split, k = ended[here], int(sides[here][0])
                        for side in np.unique(split["side"]).tolist():
                            own_side = split[split["side"] == side].tobytes()
                            out += [(int(block[s]), f"{c} {min(side, other)} {max(side, other)}", b"", b"", own_side) for other in range(k)]
                yield pd.DataFrame(out, columns=["block", "part", "bare", "named", "ended"])

    return tagged.mapInPandas(lean(run), "block long, part string, bare binary, named binary, ended binary")


def _copy(table: np.ndarray, to: np.ndarray, names: tuple[str, ...]) -> None:
    for name in names:
        to[name] = table[name]


def _meetings(tagged: DataFrame, late: tuple[np.ndarray, np.ndarray], bits: int, num: int, den: int, width: int, wide: int) -> DataFrame:
    """Pairs (a, b), a < b, of rows of different components that meet in columns of their prefixes, how often, and how often similar ones would, for each block of columns.

    At the end of the order one meeting is enough, so a pair is left to the first column
    there that both rows have among their first few: near copies just under the threshold
    meet in many columns and are named once.
    """
    enough = 1 << 30  # one meeting at the end counts as so many

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bare = np.concatenate([np.frombuffer(b, dtype=_ENTRY) for b in pdf["bare"]])
        named = np.concatenate([np.frombuffer(b, dtype=_NAMED) for b in pdf["named"]])
        ended = np.concatenate([np.frombuffer(b, dtype=_LATE) for b in pdf["ended"]])
        table = np.empty(len(bare) + len(named) + len(ended), dtype=_NAMED)
        for name in _NAMED.names:
            table[name] = np.concatenate([bare[name if name != "node" else "comp"], named[name], ended[name]])
        order = np.lexsort((table["comp"], table["col"]))
        table, odd_at = table[order], order - len(bare) - len(named)  # at the end: the place of its parities
        col, comp = table["col"], table["comp"]
        node, n, r = table["node"].astype(np.int64), table["n"].astype(np.int64), table["r"].astype(np.int64)
        start = np.flatnonzero(np.r_[True, col[1:] != col[:-1]])
        end = np.r_[start[1:], len(table)]
        mixed = (end - start > 1) & (comp[start] != comp[end - 1])
        held, done = [], []
        lower, upper = pdf["part"].iloc[0].split(" ")[1:] or (0, 0)

        pending: dict[bool, list] = {False: [], True: []}
        waiting = {False: 0, True: 0}

        def keep(i: int, j: np.ndarray, at_end: bool) -> None:
            pending[at_end].append((i, j))
            waiting[at_end] += len(j)
            if waiting[at_end] > 200_000:
                test(at_end)

        def test(at_end: bool) -> None:
            if not pending[at_end]:
                return
            i = np.repeat([x for x, _ in pending[at_end]], [len(y) for _, y in pending[at_end]])
            j = np.concatenate([y for _, y in pending[at_end]])
            pending[at_end].clear()
            waiting[at_end] = 0
            ok = (comp[i] != comp[j]) & (np.minimum(n[i], n[j]) * den >= np.maximum(n[i], n[j]) * num)
            if at_end:
                ok &= (r[i] + r[j]) * num <= np.minimum(n[i] - r[i], n[j] - r[j]) * (den - num)
                if lower != upper:
                    ok &= ended["side"][odd_at[i]] != ended["side"][odd_at[j]]
                i, j = i[ok], j[ok]
                one, other = ended["first"][odd_at[i]], ended["first"][odd_at[j]]
                ok = ~((one[:, :, None] == other[:, None, :]) & (one != _NOTHING)[:, :, None]).any((1, 2))
                i, j = i[ok], j[ok]
                apart = np.bitwise_count(ended["odd"][odd_at[i]] ^ ended["odd"][odd_at[j]]).sum(1, dtype=np.int64)
                ok = apart * (den + num) <= (n[i] + n[j]) * (den - num)
            i, j = i[ok], j[ok]
            room = [np.maximum(0, n[k] - least(n[k], num, den) + depth(n[k]) - r[k]) for k in (i, j)]
            need = np.maximum(1, depth(np.minimum(n[i], n[j])) - np.minimum(*room))
            held.append(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), np.full(len(i), enough if at_end else 1), need], 1))
            if sum(map(len, held)) > 2_000_000:
                merge()

        def merge() -> None:
            both = np.concatenate([*done, *held])
            both = both[np.lexsort((both[:, 1], both[:, 0]))]
            first = np.flatnonzero(np.r_[True, (both[1:, :2] != both[:-1, :2]).any(1)][:len(both)])
            total = both[first]
            total[:, 2] = np.add.reduceat(both[:, 2], first) if len(first) else 0
            done[:] = [total]
            held.clear()

        for s, e in zip(start[mixed], end[mixed], strict=True):
            if odd_at[s] >= 0:
                # by size before the end: partners of each come first, up to what its own size allows
                at = s + np.argsort(r[s:e], kind="stable")
                most = ((n[at] - r[at]) * (den - num)) // num - r[at]
                to = np.searchsorted(r[at], most, side="right")
                for i in range(e - s - 1):
                    if to[i] > i + 1:
                        keep(at[i], at[i + 1:to[i]], True)
            else:
                for i in range(s, e - 1):
                    # sorted by component: the rows of the others start after the last of this one
                    j = s + np.searchsorted(comp[s:e], comp[i], side="right")
                    if j < e:
                        keep(i, np.arange(j, e), False)
        test(False)
        test(True)
        if held or done:
            merge()
        out = done[0] if done else np.zeros((0, 4), dtype=np.int64)
        return pd.DataFrame(out, columns=["a", "b", "n", "need"])

    return _packed(tagged, late, bits, num, den, width, wide).groupBy("block", "part").applyInPandas(lean(run), "a long, b long, n long, need long")


def _verified(pairs: DataFrame, texts: DataFrame, num: int, den: int, width: int) -> DataFrame:
    """The pairs whose sets are similar, by their exact overlap."""
    asked = stored(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "jaccard-asked")
    own = stored(texts.join(_small(asked), "node").select("node", "text"), "jaccard-asked-texts")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kept = []
            for a, b, x, y in zip(pdf["a"], pdf["b"], shingle_sets(pdf["ta"], width), shingle_sets(pdf["tb"], width), strict=True):
                o = len(np.intersect1d(x, y, assume_unique=True))
                if den * o >= num * (len(x) + len(y) - o):
                    kept.append((a, b))
            yield pd.DataFrame(kept, columns=["a", "b"], dtype="int64")

    both = pairs.join(own.withColumnsRenamed({"node": "b", "text": "tb"}), "b").join(own.withColumnsRenamed({"node": "a", "text": "ta"}), "a")
    return stored(both.select("a", "b", "ta", "tb").mapInPandas(lean(run), "a long, b long"), "jaccard-links")
