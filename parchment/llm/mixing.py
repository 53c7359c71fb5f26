"""Mixing sources to target weights by entropy balancing, in DataFrame functions alone.

The rates r of the documents of a source minimise sum b * (r log r - r) under sum r * size = target and r <= MOST, with
base weights b = size ** (1 - TILT) * mean ** TILT. The optimum is exponentially tilted, r = min(MOST, exp(lambda * x))
with x = (size / mean) ** TILT, and the one multiplier of each source solves the convex dual. All sources take their
Newton steps together: a step is one aggregate over (source, size, n), the counts of documents by size, so a source that
holds a third of all documents is a few thousand rows there. A step that leaves its bracket is replaced by halving.

Rates become whole copies so that each source's taken tokens follow its target: every document gets floor(r) copies, and
the remainders are dealt as further copies inside classes of like size: a class's documents get one in the order of a
seeded hash until their sizes make up its remainders. What the classes of a source miss together is made good from the
class of the smallest documents upwards, so a source ends within about half of a small document of its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from parchment.llm.common import cut

TILT, MOST = 0.25, 2.0
STEPS, NEAR = 60, 1e-9
#: Documents that one task of a running sum holds, about.
RUN = 20_000
#: With so many sources or fewer, what is known of each goes to all tasks; with more, it is shuffled in PARTS copies of each.
FEW, PARTS = 50_000, 64
#: The most sources that the targets are computed for: they are one row each, ordered in one task.
MOST_SOURCES = 5_000_000


def _exact(c: Column) -> Column:
    """A number in fixed point, whose sums do not hang on the order of the rows."""
    return c.cast("decimal(28,8)")


def by_source(rows: DataFrame, own: Column, known: DataFrame, name: str, sources: int, by: list[str]) -> DataFrame:
    """rows joined with known, one row for each source, on own = name (nulls are equal): no source is one task's."""
    if sources <= FEW:
        return rows.join(F.broadcast(known), own.eqNullSafe(F.col(name)))
    a = rows.withColumn("__deal", F.pmod(F.xxhash64(*by), F.lit(PARTS)).cast("int"))
    b = known.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return a.join(b, own.eqNullSafe(F.col(name)) & (F.col("__deal") == F.col("__part"))).drop("__deal", "__part")


def targets(sizes: DataFrame, weights: list[float], share: float, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row for each source.

    Sources in code-point order, null last, weigh weights[0], weights[1], ... in turn and share `share` of all sizes. No
    target exceeds `most` times its source's size; what is above goes to the others by weight until none is above.
    That fixed point is min(most * size, level * weight): sources fill up in the order of size / weight, and the level
    is what is left over the weights that are left, at the first source that does not fill up. The sources are ordered
    in one task, so more than MOST_SOURCES are refused. A source without size has the target 0; a null source is one of its
    own; no sources give no targets.
    """
    if sizes.count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    order = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("weight", w).withColumn("cap", most * F.col("source_size")).withColumn("fill", F.col("cap") / F.col("weight"))
    by = W.orderBy("fill", F.col("source").asc_nulls_last())
    every = W.partitionBy()
    t = t.withColumn("total", share * F.sum("source_size").over(every))
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by.rowsBetween(W.currentRow, W.unboundedFollowing))
    t = t.withColumn("level", (F.col("total") - before) / left)
    level = F.min(F.when(F.col("level") < F.col("fill"), F.struct("fill", "level"))).over(every)["level"]
    return t.withColumn("level", level).select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))).cast("double").alias("target"))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def multipliers(counts: DataFrame, goals: DataFrame, sources: int, tilt: float = TILT, most: float = MOST) -> DataFrame:
    """(source, mean, full, lam): the dual's solution for each source. counts: (source, size, n) with size above 0.

    full marks a target at the source's most, where every rate is `most`.
    """
    means = counts.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.min("size").alias("least"))
    means, goals_ = means.withColumnRenamed("source", "s"), goals
    x = lambda size: F.pow(F.col(size) / F.col("mean"), F.lit(tilt))
    state = cut(
        means.join(goals_, _same(F.col("s"), F.col("source")))
        .select("source", "mean", "target", (F.col("target") >= most * F.col("source_size") * (1 - NEAR)).alias("full"), F.lit(0.0).alias("lam"), F.lit(-700.0).alias("lo"), (F.log(F.lit(most)) / x("least")).alias("hi"))
    )
    for _ in range(STEPS):
        s = state.withColumnRenamed("source", "s")
        rate = F.least(F.lit(most), F.exp(F.least(F.col("lam") * x("size"), F.lit(700.0))))
        tokens = F.col("n") * F.col("size")
        moved = (
            by_source(counts, F.col("source"), s, "s", sources, ["size"]).groupBy("source")
            .agg(F.sum(_exact(tokens * rate)).cast("double").alias("got"), F.sum(_exact(F.when(rate < most, tokens * rate * x("size")).otherwise(0.0))).cast("double").alias("slope"))
            .withColumnRenamed("source", "t").join(state, _same(F.col("t"), F.col("source")))
        )
        over = F.col("got") - F.col("target")
        done = F.col("full") | (F.abs(over) <= NEAR * F.greatest("target", F.lit(1.0)))
        lo, hi = F.when(over < 0, F.col("lam")).otherwise(F.col("lo")), F.when(over > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - over / F.nullif(F.col("slope"), F.lit(0.0))
        state = cut(
            moved.withColumn("done", done).withColumn("lo", lo).withColumn("hi", hi)
            .withColumn("lam", F.when(F.col("done"), F.col("lam")).when((newton > F.col("lo")) & (newton < F.col("hi")), newton).otherwise((F.col("lo") + F.col("hi")) / 2))
            .select("source", "mean", "target", "full", "lam", "lo", "hi", "done")
        )
        if not state.filter("not done").limit(1).count():
            break
        state = state.drop("done")
    return state.select("source", "mean", "full", "lam")


def _running(df: DataFrame, keys: list[str], value: Column, order: list[Column], runs: int) -> DataFrame:
    """Adds `before`: the sum of value over earlier rows of the same keys, dealt over `runs` tasks for each of them.

    The order's first part is the run (a slice of the hash's range), so a run's own sum and the sums of the runs before
    it give the same as one window over all of a key's rows would.
    """
    df = df.withColumn("__v", value).withColumn("run", F.pmod(F.shiftrightunsigned(F.col("hash"), 40), F.lit(runs)).cast("int"))
    sums = df.groupBy(*keys, "run").agg(F.sum("__v").alias("s"))
    offsets = sums.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("run").alias("__run"), F.coalesce(F.sum("s").over(W.partitionBy(*keys).orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("__at"))
    on = [_same(F.col(k), F.col(f"__{k}")) for k in keys] + [F.col("run") == F.col("__run")]
    own = W.partitionBy(*keys, "run").orderBy(*order)
    out = df.withColumn("__own", F.coalesce(F.sum("__v").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    return out.join(offsets, _all(on)).withColumn("before", F.col("__own") + F.col("__at")).drop("__own", "__at", "__v", "__run", "run", *[f"__{k}" for k in keys])


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def mix(docs: DataFrame, size: Column, weights: list[float], share: float, doc_id: str = "doc_id", source: str = "source", seed: int = 1, tilt: float = TILT, most: float = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies) for every row of docs.

    size: a column of whole numbers, the tokens of a row. copies lies between 0 and `most`. Rows of size 0 get rate and
    copies 0, as do sources of size 0, whose target is 0. A null source is a source of its own, the last. Rows that are
    equal in id, source and size share what falls to them in an order that does not matter. The same rows give the same
    result each time, whatever their partitions. No rows give no rows.
    """
    slim = cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.cast("long").alias("size")))
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = cut(targets(sizes, weights, share, most))
    sources = goals.count()
    rows = slim.count()
    runs = max(1, -(-rows // RUN))
    counts = cut(slim.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")))
    dual = multipliers(counts, goals, sources, tilt, most).join(goals.withColumnRenamed("source", "g"), _same(F.col("source"), F.col("g"))).select(F.col("source").alias("s"), "mean", "full", "lam", "target", "source_size")
    tilted = F.least(F.lit(most), F.exp(F.least(F.col("lam") * F.pow(F.col("size") / F.col("mean"), F.lit(tilt)), F.lit(700.0))))
    rated = by_source(slim.filter("size > 0"), F.col("source"), dual, "s", sources, ["doc_id", "size"]).withColumn("rate", F.when(F.col("full"), F.lit(most)).otherwise(tilted)).withColumn("hash", F.xxhash64(F.lit(seed), "doc_id", "size"))
    free = F.col("rate") < most
    rated = rated.withColumn("class", F.floor(F.log2("size")).cast("int")).withColumn("rest", F.when(free, (F.col("rate") - F.floor("rate")) * F.col("size")).otherwise(0.0)).withColumn("free", F.when(free, F.col("size")).otherwise(0))
    order = [F.col("hash"), F.col("doc_id"), F.col("size")]
    first = cut(_running(rated, ["source", "class"], F.col("free").cast("double"), order, runs))
    # a class takes a further copy of its documents, in hash order, until their sizes reach the class's room
    extra = free & (F.col("before") + F.col("free") / 2 <= F.col("room"))
    rooms = first.groupBy("source", "class").agg(F.sum(_exact(F.col("rest"))).cast("double").alias("room"))
    named = lambda rooms: rooms.groupBy(F.col("source").alias("s1")).agg(F.map_from_entries(F.collect_list(F.struct("class", "room"))).alias("rooms"))
    with_room = lambda rooms: by_source(first, F.col("source"), named(rooms), "s1", sources, ["doc_id", "size"]).withColumn("room", F.col("rooms")[F.col("class")]).drop("rooms")
    for _ in range(2):  # what the classes missed together is made good from the smallest class upwards
        off = with_room(rooms).groupBy("source", "class").agg(F.sum(F.when(extra, F.col("free")).otherwise(0)).alias("took"), F.sum(_exact(F.col("rest"))).cast("double").alias("rest"), F.sum("free").alias("all"))
        off = off.withColumn("miss", F.sum(F.col("rest") - F.col("took")).over(W.partitionBy("source")))
        off = off.withColumn("spare", F.when(F.col("miss") > 0, F.col("all") - F.col("took")).otherwise(F.col("took")))
        below = F.coalesce(F.sum("spare").over(W.partitionBy("source").orderBy("class").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        share = F.greatest(F.lit(0.0), F.least(F.abs("miss") - below, F.col("spare")))
        rooms = cut(off.select("source", "class", (F.col("took") + F.signum("miss") * share).alias("room")))
    copies = F.least(F.lit(int(most)), (F.floor("rate") + F.when(extra, 1).otherwise(0)).cast("int"))
    last = with_room(rooms).select("doc_id", "source", "size", "source_size", "target", "rate", copies.alias("copies"))
    empty = by_source(slim.filter("size = 0"), F.col("source"), goals.withColumnRenamed("source", "s"), "s", sources, ["doc_id"]).select("doc_id", "source", "size", "source_size", "target", F.lit(0.0).alias("rate"), F.lit(0).alias("copies"))
    return last.unionByName(empty)


def mixed(docs: DataFrame, size: Column, weights: list[float], share: float, doc_id: str = "doc_id", source: str = "source", **more) -> DataFrame:
    """docs' rows and columns as the mix takes them: each row as many times as its copies.

    Rows that share id, source and size all get the most copies that one of them has. Nulls, long texts and empty tables
    are as in mix().
    """
    keys = lambda i, s, n: [i.alias("id"), s.alias("source"), n.cast("long").alias("size"), F.xxhash64(i, s, n.cast("long")).alias("key")]
    plan = mix(docs, size, weights, share, doc_id, source, **more).filter("copies > 0").select(*keys(F.col("doc_id"), F.col("source"), F.col("size")), "copies")
    plan = plan.groupBy("id", "source", "size", "key").agg(F.max("copies").alias("copies")).select(*[F.col(c).alias(f"p_{c}") for c in ("id", "source", "size", "key", "copies")])
    rows = docs.select(*keys(F.col(f"`{doc_id}`"), F.col(f"`{source}`"), size), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = (F.col("key") == F.col("p_key")) & _all([_same(F.col(c), F.col(f"p_{c}")) for c in ("id", "source", "size")])
    return rows.join(plan, same).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("p_copies")))).select("row.*")
