"""Job states: the fold of chunks, a stream and a plain loop agree."""

import datetime as dt
import random

from evidence_lake.operators import jobs

SCHEMA = "job_id long, at timestamp, n long, to string"


def moves(seed, n):
    rng, start = random.Random(seed), dt.datetime(2024, 1, 1)
    rows = [(rng.randrange(6), start + dt.timedelta(hours=3 * i // 2), i, rng.choice([*jobs.MOVES, "unknown", None])) for i in range(n)]
    return rows + [(None, start, n, "running"), (9, None, n + 1, "running"), (7, start, n + 2, "completed")]


def loop(rows):
    out = {}
    for job, at, _, to in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[1], r[2])):
        state, ok, bad = out.get(job, (jobs.START, 0, 0))
        out[job] = (to, ok + 1, bad) if to in jobs.MOVES[state] else (state, ok, bad + 1)
    return out


def test_chunks_equal_a_loop(spark):
    rows = moves(1, 400)
    for chunk in ("hour", "day", "year"):
        got = {r.job_id: (r.state, r.accepted, r.rejected) for r in jobs.folded(spark.createDataFrame(rows, SCHEMA), chunk).collect()}
        assert got == loop(rows)
    assert jobs.folded(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rows = sorted((r for r in moves(2, 300) if r[1] is not None), key=lambda r: (r[1], r[2]))
    for i in range(0, len(rows), 100):
        spark.createDataFrame(rows[i : i + 100], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i:03d}")
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        seen = []
        query = jobs.state_stream(stream, "30 days").writeStream.outputMode("update").foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()  # noqa: B023
        query.awaitTermination()
        want = loop(rows[: i + 100])
        assert {r.job_id: (r.state, r.accepted, r.rejected) for r in seen} == {k: want[k] for k in {r[0] for r in rows[i : i + 100]} - {None}}


def test_idle_jobs_are_interrupted(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    for i, rows in enumerate([[(1, start, 0, "running"), (2, start, 1, "cancelled")], [(3, start + dt.timedelta(hours=9), 2, "running")], [(3, start + dt.timedelta(hours=10), 3, "failed")]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        seen = {} if i == 0 else seen  # noqa: F821
        query = jobs.state_stream(stream, "10 minutes", "2 hours").writeStream.outputMode("update").foreachBatch(lambda df, _: seen.update({r.job_id: r.state for r in df.collect()})).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()  # noqa: B023
        query.awaitTermination()
    assert seen == {1: "interrupted", 2: "cancelled", 3: "failed"}
