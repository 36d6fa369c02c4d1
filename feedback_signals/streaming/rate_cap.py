"""Greedy rate cap: accept an event when fewer than ``n`` accepted events of its
key lie in the trailing window.  Refused events do not count, so the rule is a
fold over time and not a window aggregate."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.lookup import salted_join
from ..session import materialize

SLICE_EVENTS = 100_000


def accept(times: np.ndarray, accepted: deque, n: int, window: int) -> np.ndarray:
    """Fold over ascending ``times`` (microseconds); ``accepted`` holds the last
    accepted times, at most ``n``, and is updated.

    A full window refuses everything up to a known time, so refused events are
    skipped by binary search: the steps taken are the accepted events.
    """
    verdict = np.zeros(len(times), dtype=bool)
    i = 0
    while i < len(times):
        t = times[i]
        while accepted and t - accepted[0] >= window:
            accepted.popleft()
        if len(accepted) < n:
            accepted.append(t)
            verdict[i] = True
            i += 1
        else:
            i += max(1, int(np.searchsorted(times[i:], accepted[0] + window)))
    return verdict


def _micros(ts: str):
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _folds(n: int, window: int):
    """The fold over a slice's times from a start state, as two column functions: the
    state it ends in (accepted times that still count after it), and its verdicts."""
    def folded(times: pa.Array, starts: pa.Array):
        flat, cuts = times.flatten().to_numpy(), times.offsets.to_numpy()
        for i, start in enumerate(starts.to_pylist()):
            slice_ = flat[cuts[i] - cuts[0]:cuts[i + 1] - cuts[0]]
            accepted = deque(start)
            yield slice_, accepted, accept(slice_, accepted, n, window)

    def end(times: pa.Array, starts: pa.Array) -> pa.Array:
        states = [[int(t) for t in held if t > slice_[-1] - window] for slice_, held, _ in folded(times, starts)]
        return pa.array(states, pa.list_(pa.int64()))

    def verdicts(times: pa.Array, starts: pa.Array) -> pa.Array:
        return pa.array([v for _, _, v in folded(times, starts)], pa.list_(pa.bool_()))

    return F.arrow_udf(end, "array<long>"), F.arrow_udf(verdicts, "array<boolean>")


def _chained(slices: DataFrame, end, at: list[str]) -> DataFrame:
    """``at, start``: the true start state of every slice.

    All slices are folded at once from a speculated state, the empty one.  Then a slice
    whose start differs from the state that its predecessor ended in is folded again,
    until none does; by induction along the slices every state is then the true one.
    Two folds over the same events soon agree whatever they start from, so few rounds
    are needed; each makes at least one more slice of a run final.
    """
    empty = F.expr("array()").cast("array<long>")
    states = materialize(slices.select(*at, empty.alias("start"), end("times", empty).alias("end")))
    before = F.lag("end").over(Window.partitionBy(*at[:-1]).orderBy(at[-1]))
    while True:
        told = materialize(states.select(*at, "start", "end", F.coalesce(before, empty).alias("told")))
        stale = told.filter(F.col("told") != F.col("start")).select(*at, F.col("told").alias("start"))
        if stale.isEmpty():
            return told.select(*at, "start")
        again = slices.join(stale, at).select(*at, "start", end("times", "start").alias("end"))
        states = materialize(told.filter(F.col("told") == F.col("start")).select(*at, "start", "end").unionByName(again))


def rate_cap(
    events: DataFrame, key: str = "key", ts: str = "ts", n: int = 5, seconds: float = 60, event_id: str = "event_id",
    slice_events: int = SLICE_EVENTS,
) -> DataFrame:
    """``events`` plus ``accepted``, which is null where the key is.  ``event_id`` names
    an event; events of one time are taken by ascending id.

    A pause of a whole window resets a key, so its events fall into independent runs,
    found on counts per (key, slot of time).  Runs of at most ``n`` events are accepted
    as they stand.  The others are cut into slices of about ``slice_events`` (a slot, a
    16th of a window, is not cut), which are folded in parallel and chained by their
    end states, so a client that never pauses is many tasks.  Only key, id and time
    travel; the verdict is joined back.
    """
    window = int(seconds * 1_000_000)
    timed = events.filter(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(event_id).alias("_id"), _micros(ts).alias("_t"))
    timed = timed.withColumn("_slot", F.floor(F.col("_t") / max(window // 16, 1)))
    slots = timed.groupBy("_key", "_slot").agg(F.min("_t").alias("_from"), F.max("_t").alias("_to"), F.count("*").alias("_n"))
    in_time = Window.partitionBy("_key").orderBy("_slot")
    pause = F.col("_from") - F.lag("_to").over(in_time) >= window
    runs = slots.withColumn("_run", F.sum(F.coalesce(pause, F.lit(True)).cast("int")).over(in_time))
    whole = Window.partitionBy("_key", "_run")
    earlier = whole.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_size", F.sum("_n").over(whole)).withColumn(
        "_slice", F.floor(F.coalesce(F.sum("_n").over(earlier), F.lit(0)) / slice_events)
    ).select("_key", "_slot", "_run", "_slice", "_size")
    placed = materialize(salted_join(timed, runs, ["_key", "_slot"], "inner"))
    easy = placed.filter(F.col("_size") <= n).select("_id", F.lit(True).alias("accepted"))
    at = ["_key", "_run", "_slice"]
    slices = materialize(placed.filter(F.col("_size") > n).groupBy(*at).agg(
        F.array_sort(F.collect_list(F.struct("_t", "_id"))).alias("events")
    ).select(*at, F.col("events._t").alias("times"), F.col("events._id").alias("ids")))
    end, verdicts = _folds(n, window)
    judged = slices.join(_chained(slices, end, at), at).select(
        F.explode(F.arrays_zip(F.col("ids").alias("id"), verdicts("times", "start").alias("accepted"))).alias("e")
    ).select(F.col("e.id").alias("_id"), "e.accepted")
    known = easy.unionByName(judged)
    return events.join(known, F.col(event_id) == F.col("_id"), "left").drop("_id")


def rate_cap_stream(
    events: DataFrame, key: str = "key", ts: str = "ts", n: int = 5, seconds: float = 60,
    event_id: str = "event_id", delay: str = "1 minute",
) -> DataFrame:
    """The same rule on a stream of ``(event_id, key, ts)``.

    State is ``n`` times per key, dropped when the watermark is a window past
    the last one.  Within a micro-batch events are taken in time order; an event
    older than one already accepted from an earlier batch is judged on arrival.
    """
    window = int(seconds * 1_000_000)
    out = events.schema[event_id].dataType.simpleString(), events.schema[key].dataType.simpleString()
    schema = f"`{event_id}` {out[0]}, `{key}` {out[1]}, _t long, accepted boolean"

    def fold(group, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        accepted = deque(state.get[0]) if state.exists else deque()
        rows = pd.concat(list(batches)).sort_values(["_t", event_id])
        verdict = accept(rows["_t"].to_numpy(), accepted, n, window)
        state.update(([int(t) for t in accepted],))
        if accepted:
            ends = int(accepted[-1] + window) // 1000 + 1
            state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield rows.assign(accepted=verdict)[[event_id, key, "_t", "accepted"]]

    timed = (
        events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
        .select(event_id, key, F.unix_micros("_ts").alias("_t"), "_ts")
    )
    judged = timed.groupBy(key).applyInPandasWithState(
        fold, schema, "times array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )
    return judged.withColumn(ts, F.timestamp_micros("_t")).drop("_t")
