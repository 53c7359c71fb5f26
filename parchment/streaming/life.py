"""The life of files as a stream: the fold of operators.lifecycle, held as state, with events put in order by the watermark."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parchment.operators.lifecycle import COUNTED, MOVES, STATES

HELD = "state int, counts string, since timestamp, waiting string"
OUT = f"file_name string, state string, {', '.join(f'{k} long' for k in COUNTED)}, refused long, since timestamp"


def step(state: int, counts: dict[str, int], kind: str) -> tuple[int, bool]:
    """The state behind an event, and whether it changed; counts are kept."""
    to = MOVES[kind][state]
    name = kind if to != state else "refused"
    if name in counts:
        counts[name] += 1
    return to, to != state


def _advance(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
    state, counts, since, waiting = 0, {**dict.fromkeys(COUNTED, 0), "refused": 0}, None, []
    if held.exists:
        state, told, since, kept = held.get
        counts, waiting = json.loads(told), json.loads(kept)
    for f in frames:
        waiting += [[int(t.value // 1000), int(i), k] for t, i, k in zip(f["ts"], f["event_id"], f["kind"], strict=True)]
    mark = held.getCurrentWatermarkMs() * 1000
    ready = sorted(w for w in waiting if w[0] < mark)
    waiting = [w for w in waiting if w[0] >= mark]
    for us, _, kind in ready:
        state, moved = step(state, counts, kind)
        since = pd.Timestamp(us * 1000).to_pydatetime() if moved else since
    held.update((state, json.dumps(counts), since, json.dumps(waiting)))
    if waiting:
        held.setTimeoutTimestamp(max(mark // 1000 + 1, min(w[0] for w in waiting) // 1000 + 1))
    if ready:
        yield pd.DataFrame([{"file_name": key[0], "state": STATES[state], **counts, "since": since}])


def lives(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A stream of (file_name, state, counts, since) from a stream of (file_name, event_id, ts, kind): a row whenever a file moves on.

    Events wait until the watermark has passed them, then count in order of time and id; what comes later than that is dropped, as
    are events that come again within it. So a file's last row is the batch's fold() of its events up to the watermark. State is
    a file's number of state, its counts and the events that wait; a restart from the checkpoint goes on where it ended.
    """
    e = events.select("file_name", "event_id", "ts", "kind").filter(F.col("kind").isin(list(MOVES)) & F.col("file_name").isNotNull())
    once = e.withWatermark("ts", late).dropDuplicatesWithinWatermark(["file_name", "event_id"])
    return once.groupBy("file_name").applyInPandasWithState(_advance, OUT, HELD, "append", GroupStateTimeout.EventTimeTimeout)
