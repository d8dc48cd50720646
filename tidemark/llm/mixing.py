"""Mixing sources to target weights: pivotal dependent rounding, with DataFrame functions alone.

A document of a source that is to give `target` of its `source_size` words is wanted
target / source_size times. The whole part is taken; the fraction is a probability of one
copy more. Two such documents meet: mass (words times probability) moves from one to the
other, in a direction drawn so that each one's expectation stays, until one of them is at
0 or 1. So a source's words stay what they were, but for the last document open.

The tree: documents of one source and size class (a power of two) are dealt by hash to
leaves of about 32; a fold over a leaf settles all but one document, its residual; 32
leaves' residuals meet in the next node, and so on. What is left of a source, at most 64
residuals of each class and one leaf of each class that was set aside, meets at its root
from large to small. The last one open is drawn by itself; the words this puts the source
off, under one document, are made up by the root's other documents that turn, from large
to small, where it brings the source nearer. Masses are whole numbers of 2^-20 words: nothing is lost to rounding on the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import columns_of, few, stored

#: Documents of a leaf, and residuals of a node, on average; up to twice as many go on to the root as they are.
FAN = 32
#: Parts of a word that masses count in.
PARTS = 1 << 20
_UNIT = ("size", "hash", "mass", "doc_id", "print", "rows", "base")


def ranked(sources: DataFrame) -> DataFrame:
    """sources (one row each) with `rank` from 0 by code point, null last: ranges are sorted apart and shifted by the rows before them."""
    parts = sources.repartitionByRange(F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id())
    parts = stored(parts, "mixing-sources")
    before = parts.groupBy("part").count()  # a row for each range
    before = before.withColumn("before", F.sum("count").over(W.orderBy("part")) - F.col("count")).drop("count")
    own = F.row_number().over(W.partitionBy("part").orderBy(F.asc_nulls_last("source")))
    return parts.join(before, "part").withColumn("rank", own + F.col("before") - 1).drop("part", "before")


def targets(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """sources(source, source_size) with the words each is to give.

    Sources in order of code point, null last, weigh `weights`, repeating, and share
    `share` times all words. None gives more than `most` times its size: the excess is
    shared by weight among the others until none is above. A source without words gives none.
    """
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    s = stored(ranked(sources).select("source", "source_size", turn.cast("long").alias("weight"), (F.col("source_size") * most).alias("cap")), "mixing-ranks")
    level, budget = 0.0, None
    while True:  # the level only rises, and each round but the last closes a source
        full = F.col("cap") <= F.col("weight") * F.lit(level)
        row = s.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("cap")).otherwise(0)).alias("closed"),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        budget = (row["all"] or 0) * share
        now = (budget - row["closed"]) / row["open"] if row["open"] else level
        if now <= level:
            break
        level = now
    return s.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level)).alias("target"))


def _uniform(seed: int, *columns: Column) -> Column:
    """A number from 0 to 1 that is the same on every run."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / F.lit(float(1 << 53))


def _fold(units: Column, seed: int, unit: str) -> Column:
    """The array `units` of open documents, each met with the one left of those before: struct(left, settled)."""
    settled = f"array<struct<unit:{unit},up:boolean>>"

    def meet(state: Column, u: Column) -> Column:
        left = state["left"]
        a, b = left["mass"], u["mass"]
        room_a, room_b = left["size"] * PARTS - a, u["size"] * PARTS - b
        gain, loss = F.least(room_a, b), F.least(a, room_b)  # what the one left can gain from u, and lose to it
        gains = _uniform(seed, left["hash"], u["hash"]) * (gain + loss) < loss
        mass_a, mass_b = F.when(gains, a + gain).otherwise(a - loss), F.when(gains, b - gain).otherwise(b + loss)
        open_a, open_b = (mass_a > 0) & (mass_a < left["size"] * PARTS), (mass_b > 0) & (mass_b < u["size"] * PARTS)
        done = F.concat(
            F.when(open_a, F.array().cast(settled)).otherwise(F.array(F.struct(left.alias("unit"), (mass_a > 0).alias("up")))),
            F.when(open_b, F.array().cast(settled)).otherwise(F.array(F.struct(u.alias("unit"), (mass_b > 0).alias("up")))),
        )
        # at most one of the two is open still
        next_left = F.when(open_a, left.withField("mass", mass_a)).when(open_b, u.withField("mass", mass_b))
        return F.when(left.isNull(), F.struct(u.alias("left"), state["settled"].alias("settled"))).otherwise(
            F.struct(next_left.alias("left"), F.concat(state["settled"], done).alias("settled"))
        )

    start = F.struct(F.lit(None).cast(unit).alias("left"), F.array().cast(settled).alias("settled"))
    in_order = F.reverse(F.array_sort(units))  # by size, from large to small, then by hash
    return F.aggregate(in_order, start, meet)


def _levelled(settled: str, over: Column) -> Column:
    """The array `settled`, in which documents, from large to small, turn where that brings `over`, the mass taken too much, nearer to 0."""
    item = F.transform(F.col(settled), lambda x: F.struct(x["unit"]["size"].alias("size"), x["unit"]["hash"].alias("hash"), x["unit"].alias("unit"), x["up"].alias("up")))

    def turn(state: Column, x: Column) -> Column:
        change = F.when(x["up"], -x["size"]).otherwise(x["size"]) * PARTS
        better = F.abs(state["over"] + change) < F.abs(state["over"])
        now = F.struct(x["unit"].alias("unit"), (x["up"] != better).alias("up"))
        return F.struct(F.when(better, state["over"] + change).otherwise(state["over"]).alias("over"), F.concat(state["out"], F.array(now)).alias("out"))

    start = F.struct(over.alias("over"), F.filter(F.col(settled), lambda x: F.lit(False)).alias("out"))
    return F.aggregate(F.reverse(F.array_sort(item)), start, turn)["out"]


def rounded(units: DataFrame, seed: int = 11) -> DataFrame:
    """units(source, size, hash, mass, doc_id, print, rows, base) with `up`: whether the unit's mass became one copy more.

    Mass is in 1 / PARTS words and at most the size; hash tells a source's units apart.
    A source's mass becomes whole copies of the same words, but for what its root can't level out.
    """
    packed = units.withColumn("unit", F.struct(*_UNIT)).select("source", "unit", F.floor(F.log2(F.greatest("size", F.lit(1)))).cast("int").alias("class"))
    unit = packed.schema["unit"].dataType.simpleString()
    at_once = (F.col("unit.mass") <= 0) | (F.col("unit.mass") >= F.col("unit.size") * PARTS)
    packed = stored(packed.withColumn("settled", at_once), "mixing-units")
    done = [packed.where("settled").select("source", "unit", (F.col("unit.mass") > 0).alias("up"))]
    open_ = packed.where("not settled").drop("settled")
    counts = stored(open_.groupBy("source", "class").agg(F.ceil(F.count("*") / F.lit(FAN)).alias("nodes")), "mixing-classes")
    c = few(counts.withColumnsRenamed({"source": "_source", "class": "_class"}))
    here = open_.join(c, F.col("source").eqNullSafe(F.col("_source")) & (F.col("class") == F.col("_class"))).drop("_source", "_class")
    here = here.withColumn("node", F.pmod(F.xxhash64(F.lit(seed), "unit.hash"), F.col("nodes")))
    small = F.col("nodes") <= 2
    root = [here.where(small | (F.col("node") == 0)).select("source", "unit")]
    here, widest = here.where(~small & (F.col("node") > 0)), counts.agg(F.max("nodes")).first()[0] or 0
    while widest > 2:
        grouped = here.groupBy("source", "class", "nodes", "node").agg(_fold(F.collect_list("unit"), seed, unit).alias("f"))
        level = stored(grouped.select("source", "class", "nodes", "node", "f.*"), "mixing-level")
        done.append(level.select("source", F.explode("settled").alias("s")).select("source", "s.unit", "s.up"))
        up = level.where("left is not null").select(
            "source", "class", F.ceil(F.col("nodes") / F.lit(FAN)).alias("nodes"), F.floor(F.col("node") / F.lit(FAN)).alias("node"), F.col("left").alias("unit"))
        root.append(up.where(F.col("nodes") <= 2).select("source", "unit"))
        here, widest = up.where(F.col("nodes") > 2), -(-widest // FAN)
    rest = root[0]
    for r in root[1:]:
        rest = rest.union(r)
    top = rest.groupBy("source").agg(_fold(F.collect_list("unit"), seed, unit).alias("f")).select("source", "f.*")
    last = _uniform(seed, F.col("left.hash")) * F.col("left.size") * PARTS < F.col("left.mass")
    top = stored(top.withColumn("last", last), "mixing-root")
    over = F.when(F.col("left").isNull(), F.lit(0).cast("long")).otherwise(F.when(F.col("last"), F.col("left.size") * PARTS).otherwise(0) - F.col("left.mass"))
    done.append(top.select("source", F.explode(_levelled("settled", over)).alias("s")).select("source", "s.unit", "s.up"))
    done.append(top.where("left is not null").select("source", F.col("left").alias("unit"), F.col("last").alias("up")))
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out.select("source", "unit.*", "up")


def _print(text: str = "text") -> Column:
    return F.struct(F.xxhash64(F.lit(1), text).alias("a"), F.xxhash64(F.lit(2), text).alias("b"))


def plan(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 11) -> DataFrame:
    """How often the mix takes each of docs(doc_id, source, text).

    Rows (doc_id, source, print, rows, size, source_size, target, copies): one for the
    `rows` documents alike in id, source and text, that together are taken `copies` times;
    `print` is 128 bits of the text. Size is the text's words, maximal runs of characters
    other than U+0020 and U+0009 to U+000D. Targets as in targets(); copies are whole ones, so a
    source of a few documents may be off by up to one of them. A null or empty text
    has no words and gets the copies of any other; a null source is a source, the last;
    null and repeated ids are rows like others. Reruns agree; `seed` makes another mix.
    Other columns are dropped. No rows give no rows.
    """
    size = F.coalesce(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")
    rows = columns_of(docs, "doc_id", "source", "text").select("doc_id", "source", size.alias("size"), _print().alias("print"))
    rows = stored(rows.groupBy("doc_id", "source", "size", "print").agg(F.count("*").alias("rows")), "mixing-documents")
    s = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    s = few(stored(targets(s, weights, share, most), "mixing-targets").withColumnRenamed("source", "_source"))
    both = F.col("source").eqNullSafe(F.col("_source"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = (
        rows.join(s, both).withColumn("wanted", rate * F.col("rows")).withColumn("base", F.floor("wanted"))
        .withColumn("mass", F.round((F.col("wanted") - F.col("base")) * F.col("size") * PARTS).cast("long"))
        .withColumn("hash", F.xxhash64(F.lit(seed), "doc_id", "print.a", "print.b", "source"))
    )
    out = rounded(units.select("source", *_UNIT), seed)
    out = out.withColumn("copies", F.col("base") + F.col("up").cast("long"))
    return out.join(s, both).select("doc_id", "source", "print", "rows", "size", "source_size", "target", "copies")


def each_row(plan: DataFrame) -> DataFrame:
    """plan() with one row a document: alike ones share their copies as evenly as can be. Column `taken` is the words it gives."""
    block = 1 << 14  # no list of all of a million rows alike
    ordinal = F.col("_block") * block + F.col("_own")
    d = plan.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / block))))
    d = d.withColumn("_own", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(block), F.col("rows") - F.col("_block") * block) - 1)))
    copies = F.floor(F.col("copies") / F.col("rows")) + (ordinal < F.col("copies") % F.col("rows")).cast("long")
    return d.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).drop("_block", "_own", "rows", "print")


def mixed(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The mix itself: rows (doc_id, source, text), each as often as plan(docs) says."""
    d = columns_of(docs, "doc_id", "source", "text").withColumn("print", _print())
    d = d.groupBy("doc_id", "source", "print").agg(F.first("text").alias("text"))
    p = plan.where("copies > 0").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("print").alias("_print"), "copies")
    both = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("print") == F.col("_print"))
    block = F.lit(1 << 14).cast("long")
    d = d.join(p, both).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / block))))
    times = F.sequence(F.lit(1).cast("long"), F.least(block, F.col("copies") - F.col("_block") * block))
    return d.withColumn("_time", F.explode(times)).select("doc_id", "source", "text")
