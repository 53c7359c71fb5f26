"""The life of a file: arrivals, claims, completions, reverts and recoveries as a fold over its ordered events.

An event maps the state before it to the one behind it, so a run of events is a table from states to states, and tables
of neighbouring runs compose. In batch a file's events are cut into runs of bounded length, each run becomes its table in a
task of its own, and the tables are composed: a file with most of all events is nobody's burden. The stream (streaming.life) takes
the same table of transitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.operators.queue import places

#: States by number: absent, unprocessed, processing, processed.
STATES = ["absent", "unprocessed", "processing", "processed"]
#: For each kind of event the state behind it, by the state before. Where nothing changes the event is refused.
MOVES = {"arrive": [1, 1, 2, 1], "claim": [0, 2, 2, 3], "complete": [0, 1, 3, 3], "revert": [0, 1, 1, 3], "recover": [0, 1, 1, 3]}
COUNTED = ["claim", "complete", "revert", "recover"]
#: Events of one file that are folded in one task.
RUN = 4096


def _start(state: int) -> Column:
    zero = F.lit(0).cast("long")
    return F.struct(F.lit(state).alias("state"), *[zero.alias(k) for k in COUNTED], zero.alias("refused"), F.lit(None).cast("timestamp").alias("since"))


def _step(held: Column, event: Column) -> Column:
    moves = F.array(*[F.array(*[F.lit(s) for s in to]) for to in MOVES.values()])
    to = F.element_at(F.element_at(moves, event["kind"]), held["state"] + 1)
    moved = to != held["state"]
    count = lambda k: held[k] + F.when(moved & (event["kind"] == list(MOVES).index(k) + 1), 1).otherwise(0).cast("long")
    return F.struct(to.alias("state"), *[count(k).alias(k) for k in COUNTED], (held["refused"] + F.when(moved, 0).otherwise(1).cast("long")).alias("refused"), F.when(moved, event["ts"]).otherwise(held["since"]).alias("since"))


def _then(held: Column, table: Column) -> Column:
    run = F.element_at(table, held["state"] + 1)
    return F.struct(run["state"].alias("state"), *[(held[k] + run[k]).alias(k) for k in [*COUNTED, "refused"]], F.coalesce(run["since"], held["since"]).alias("since"))


def fold(events: DataFrame, run: int = RUN) -> DataFrame:
    """(file_name, state, claim, complete, revert, recover, refused, since) from (file_name, event_id, ts, kind).

    Events count in order of ts, then event_id, wherever they lie in the table; one that is there twice counts once. claim to
    recover: how many of each were carried out; refused: events that changed nothing, an arrival of a file that is there
    among them. since: when the state was reached. Unknown kinds, and rows without a file or a time, are no events.
    """
    code = F.array_position(F.array(*[F.lit(k) for k in MOVES]), F.col("kind")).cast("int")
    e = events.select("file_name", "event_id", F.col("ts").cast("timestamp").alias("ts"), code.alias("kind")).filter("kind > 0 AND file_name IS NOT NULL AND ts IS NOT NULL").distinct()
    cut = places(e, "file_name", F.col("ts"), "event_id").withColumn("run", F.floor((F.col("place") - 1) / run))
    ordered = F.sort_array(F.collect_list(F.struct("place", "kind", "ts")))  # run at most
    starts = F.array(*[_start(s) for s in range(len(STATES))])
    tables = cut.groupBy("file_name", "run").agg(F.aggregate(ordered, starts, lambda held, x: F.transform(held, lambda h: _step(h, x))).alias("table"))
    runs = F.transform(F.sort_array(F.collect_list(F.struct("run", "table"))), lambda r: r["table"])
    out = tables.groupBy("file_name").agg(F.aggregate(runs, _start(0), _then).alias("x"))
    names = F.array(*[F.lit(s) for s in STATES])
    return out.select("file_name", F.element_at(names, F.col("x.state") + 1).alias("state"), *[F.col(f"x.{k}").alias(k) for k in [*COUNTED, "refused", "since"]])


def free_names(arrivals: DataFrame, taken: DataFrame) -> DataFrame:
    """arrivals (file_name, and order, a column that no two of a name share) with saved_name, the name each is kept under.

    Of the arrivals of a name the first keeps it if no file of taken (file_name) bears it; the others get the name with _1, _2
    and so on before its ending, passing over numbers whose names are taken or borne by another arrival. Rows without a name
    have none. The k-th free number of a name is the place of k among the numbers k and the used ones less their own
    places, so two rankings by ranges find it for any number of files of one name.
    """
    stem, ending = F.regexp_extract("file_name", r"(?s)^(.*?)(\.[^./]*)?$", 1), F.regexp_extract("file_name", r"(?s)^(.*?)(\.[^./]*)?$", 2)
    used = taken.select("file_name").unionByName(arrivals.select("file_name")).filter("file_name IS NOT NULL").distinct()
    placed = places(arrivals.filter("file_name IS NOT NULL"), "file_name", F.col("order"), "order")
    held = taken.select("file_name").distinct().withColumn("held", F.lit(1))
    wanting = placed.join(held, "file_name", "left").withColumn("k", F.col("place") - 1 + F.coalesce("held", F.lit(0))).drop("place", "held")
    numbered = used.select(ending.alias("ending"), F.regexp_extract(stem, r"(?s)^(.*)_([1-9][0-9]{0,17})$", 1).alias("stem"), F.regexp_extract(stem, r"(?s)^(.*)_([1-9][0-9]{0,17})$", 2).try_cast("long").alias("number")).filter("number IS NOT NULL")
    numbers = places(numbered.select(F.concat("stem", F.lit("/"), "ending").alias("name"), "number"), "name", F.col("number"), "number")
    gaps = numbers.select("name", (F.col("number") - F.col("place")).alias("key"), F.lit(1).alias("side"), F.lit(None).cast("string").alias("file_name"), F.lit(None).cast(arrivals.schema["order"].dataType).alias("order"))
    # A used number r of place j lies below the k-th free one if r - j < k; so at equal keys the asking row comes first.
    asking = wanting.filter("k > 0").select(F.concat(stem, F.lit("/"), ending).alias("name"), F.col("k").alias("key"), F.lit(0).alias("side"), "file_name", "order")
    both = places(gaps.unionByName(asking), "name", F.struct("key", "side"), "order").filter("side = 0")
    renamed = both.select("file_name", "order", F.concat(stem, F.lit("_"), F.col("place").cast("string"), ending).alias("saved_name"))
    out = wanting.filter("k = 0").withColumn("saved_name", F.col("file_name")).drop("k").unionByName(wanting.filter("k > 0").drop("k").join(renamed, ["file_name", "order"]).select(*[c for c in wanting.columns if c != "k"], "saved_name"))
    return out.unionByName(arrivals.filter("file_name IS NULL").withColumn("saved_name", F.lit(None).cast("string")))
