"""Jobs' states from the moves asked for: illegal moves are rejected, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The states of a job and the moves from each.
MOVES = {
    "queued": ("running", "cancel_requested", "cancelled"),
    "running": ("completed", "completed_with_errors", "failed", "cancel_requested", "interrupted"),
    "cancel_requested": ("cancelled", "completed", "completed_with_errors", "failed", "interrupted"),
    "completed_with_errors": ("queued",),
    "failed": ("queued",),
    "cancelled": ("queued",),
    "interrupted": ("queued",),
    "completed": (),
}
START = "queued"
#: States that end when nothing is heard of the job.
ACTIVE = ("running", "cancel_requested")


def legal(state: Column, to: Column) -> Column:
    allowed = F.create_map(*[x for s, ts in MOVES.items() for x in (F.lit(s), F.array(*map(F.lit, ts)).cast("array<string>"))])
    return F.array_contains(allowed[state], to)


def folded(moves: DataFrame, chunk: str = "day") -> DataFrame:
    """job_id, state, accepted, rejected after all moves (job_id, at, n, to), in the order of (at, n), from START.

    The moves of a chunk of time become a table from each state to the state after them, and a job's tables are
    followed one after the other: no task holds more than a job's chunk, or its tables. A null or unknown `to` is
    rejected; rows without a job or time take no part.
    """
    known = F.when(F.col("to").isin(*MOVES), F.col("to")).otherwise("")
    part = F.date_trunc(chunk, "at").alias("part")
    arrays = moves.where("job_id IS NOT NULL AND at IS NOT NULL").groupBy("job_id", part).agg(F.array_sort(F.collect_list(F.struct("at", "n", known.alias("to")))).alias("asked"))

    def step(acc: Column, move: Column) -> Column:
        return F.when(legal(acc["state"], move["to"]), F.struct(move["to"].alias("state"), (acc["ok"] + 1).alias("ok"))).otherwise(acc)

    def after(state: Column) -> Column:
        return F.aggregate("asked", F.struct(state.alias("state"), F.lit(0).cast("long").alias("ok")), step)

    tables = arrays.select("job_id", "part", F.size("asked").alias("n"), F.map_from_arrays(F.array(*map(F.lit, MOVES)), F.array(*[after(F.lit(s)) for s in MOVES])).alias("table"))
    jobs = tables.groupBy("job_id").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("part", F.map_entries("table").alias("table")))).alias("parts"))

    def follow(acc: Column, entry: Column) -> Column:
        then = F.filter(entry["table"], lambda e: e["key"] == acc["state"])[0]["value"]
        return F.struct(then["state"].alias("state"), (acc["ok"] + then["ok"]).alias("ok"))

    end = F.aggregate("parts", F.struct(F.lit(START).alias("state"), F.lit(0).cast("long").alias("ok")), follow)
    return jobs.select("job_id", "n", end.alias("end")).select("job_id", "end.state", F.col("end.ok").alias("accepted"), (F.col("n") - F.col("end.ok")).alias("rejected"))


def state_stream(moves: DataFrame, late: str = "1 hour", idle: str | None = None) -> DataFrame:
    """The same as a stream of moves (job_id, at, n, to): after each batch a row for each job that it moved, with state, accepted and rejected so far.

    Moves later than the watermark are left out. With `idle` (an interval) an active job of which nothing is
    heard for so long becomes interrupted.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    wait = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else 0

    def moved(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, ok, bad, last = held.get if held.exists else (START, 0, 0, 0)
        if held.hasTimedOut:
            if state in ACTIVE:
                state, ok = "interrupted", ok + 1
        else:
            asked = pd.concat(list(batches)).sort_values(["at", "n"])  # a job's moves of one batch
            for to in asked["to"]:
                if to in MOVES[state]:
                    state, ok = to, ok + 1
                else:
                    bad += 1
            last = max(last, int(asked["at"].max().timestamp() * 1000))
        held.update((state, ok, bad, last))
        if wait and state in ACTIVE:
            held.setTimeoutTimestamp(max(last + wait, held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"job_id": [key[0]], "state": [state], "accepted": [ok], "rejected": [bad]})

    kind = dict(moves.dtypes)["job_id"]
    own = moves.select("job_id", "at", "n", "to").where("job_id IS NOT NULL AND at IS NOT NULL").withWatermark("at", late)
    return own.groupBy("job_id").applyInPandasWithState(moved, f"job_id {kind}, state string, accepted long, rejected long", "state string, ok long, bad long, last long", "update", GroupStateTimeout.EventTimeTimeout if wait else GroupStateTimeout.NoTimeout)
