"""Lives of files and their names, against plain loops; the stream against the batch."""

import datetime as dt
import random
from pathlib import PurePath

from pyspark.sql import functions as F

from parchment.operators import lifecycle
from parchment.streaming import life

SCHEMA = "file_name string, event_id long, ts timestamp, kind string"
START = dt.datetime(2025, 1, 1)


def some_events(n=400, files=5, seed=3):
    rng = random.Random(seed)
    names = [f"f{k}.pdf" for k in range(files)]
    return [(rng.choice(names[: 1 + rng.randrange(files)]), k, START + dt.timedelta(seconds=rng.randrange(200)), rng.choice([*lifecycle.MOVES, "arrive", "claim"])) for k in range(n)]


def plain(events):
    out = {}
    for name, _, ts, kind in sorted(set(events), key=lambda e: (e[2], e[1])):
        state, counts, since = out.get(name, (0, dict.fromkeys([*lifecycle.COUNTED, "refused"], 0), None))
        to, moved = life.step(state, counts, kind)
        out[name] = (to, counts, ts if moved else since)
    return {n: (lifecycle.STATES[s], *c.values(), t) for n, (s, c, t) in out.items()}


def test_transitions_are_those_of_an_inbox():
    s = {n: k for k, n in enumerate(lifecycle.STATES)}
    go = lambda state, kind: lifecycle.STATES[lifecycle.MOVES[kind][s[state]]]
    assert go("absent", "arrive") == "unprocessed" and go("unprocessed", "claim") == "processing" and go("processing", "claim") == "processing"
    assert go("processing", "complete") == "processed" and go("unprocessed", "complete") == "unprocessed" and go("processing", "revert") == go("processing", "recover") == "unprocessed"
    assert go("processed", "arrive") == "unprocessed" and go("absent", "claim") == "absent"


def test_fold_of_runs_of_any_length(spark):
    events = some_events()
    odd = [(None, 900, START, "claim"), ("f0.pdf", 901, None, "claim"), ("f0.pdf", 902, START, "odd"), ("f0.pdf", 903, START, None)]
    df = spark.createDataFrame(events + odd + events[:50], SCHEMA).withColumn("run", F.lit("x"))
    for run in (1, 7, 4096):
        assert {r[0]: tuple(r)[1:] for r in lifecycle.fold(df, run).collect()} == plain(events)
    assert lifecycle.fold(df.limit(0)).count() == 0


def test_stream_gives_the_fold_also_after_a_restart(spark, tmp_path):
    """Events that are late within the watermark, repeated, and split over two runs from one checkpoint."""
    events = [e for e in some_events(300, 3, 5)]
    mark = ("mark.pdf", 10**6, START + dt.timedelta(days=1), "arrive")
    put = lambda rows, k: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")

    def run():
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = life.lives(stream, "1 hour").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()

    put(events[:150] + events[:20], 0)
    run()
    put(events[150:] + events[100:160], 1)
    run()
    put([mark], 2)
    run()
    put([("mark.pdf", 10**6 + 1, START + dt.timedelta(days=2), "claim")], 3)
    run()
    got = {}
    for r in sorted(spark.read.parquet(f"{tmp_path}/out").collect(), key=lambda r: r.claim + r.complete + r.revert + r.recover + r.refused):
        got[r.file_name] = tuple(r)[1:]
    got.pop("mark.pdf", None)
    want = plain(events)
    assert {k: v[:-1] for k, v in got.items()} == {k: v[:-1] for k, v in want.items()}
    assert {k: v[-1] for k, v in got.items()} == {k: v[-1] for k, v in want.items()}


def test_names_take_the_smallest_free_numbers(spark):
    rng = random.Random(9)
    names = ["a.pdf"] * 40 + ["a_2.pdf", "a_3.pdf", "b", "b", "b_1", "b_01", "c.x.pdf", "c.x.pdf", "c.x_1.pdf", "é.pdf", "é.pdf"]
    rng.shuffle(names)
    arrivals = [(n, k, "kept") for k, n in enumerate(names)] + [(None, 999, "kept")]
    taken = ["a.pdf", "a_1.pdf", "a_7.pdf", "a_7.pdf", "a_9.txt", "c.x.pdf"]
    used, given, want = set(taken) | set(names), set(), {}
    for n, k, _ in arrivals:
        if n is None:
            want[k] = None
        elif n not in taken and n not in given:
            want[k] = n
            given.add(n)
        else:
            p, i = PurePath(n), 1
            while f"{p.stem}_{i}{p.suffix}" in used or f"{p.stem}_{i}{p.suffix}" in given:
                i += 1
            want[k] = f"{p.stem}_{i}{p.suffix}"
            given.add(want[k])
    a, t = spark.createDataFrame(arrivals, "file_name string, order long, more string"), spark.createDataFrame([(n,) for n in taken], "file_name string")
    got = lifecycle.free_names(a, t).collect()
    assert {r.order: r.saved_name for r in got} == want and len(got) == len(arrivals) and {r.more for r in got} == {"kept"}
    assert lifecycle.free_names(a.limit(0), t).count() == 0 and lifecycle.free_names(a, t.limit(0)).count() == len(arrivals)
