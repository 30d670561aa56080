"""Calls in flight: shares of calls give what single calls give, batch by batch."""

import random

import pandas as pd
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from threadloom.streaming import runner, state

AFTER_S = 10


def single_calls(events, after_s, delay="0 seconds"):
    """The same with a state and a timer for each call."""

    def process(key, frames, state):
        begun, ended = state.get if state.exists else (None, None)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame(
                {
                    "id": [key[0]], "begun": pd.array([begun], "Int64"), "ended": pd.array([ended], "Int64"),
                    "outcome": ["abandoned" if begun is not None else "orphan"]
                }
            )
            return
        for frame in frames:
            for phase, ms in zip(frame["phase"], frame["ms"]):
                if phase == "begin":
                    begun = int(ms) if begun is None else min(begun, int(ms))
                else:
                    ended = int(ms) if ended is None else max(ended, int(ms))
        if begun is not None and ended is not None:
            if state.exists:
                state.remove()
            late = ended - begun > after_s * 1000
            yield pd.DataFrame(
                {
                    "id": [key[0]], "begun": pd.array([begun], "Int64"), "ended": pd.array([ended], "Int64"),
                    "outcome": ["abandoned" if late else "done"]
                }
            )
        else:
            state.update((begun, ended))
            state.setTimeoutTimestamp(max((begun if begun is not None else ended) + after_s * 1000, state.getCurrentWatermarkMs() + 1))

    rows = events.withColumn("ms", F.unix_millis("at")).withWatermark("at", delay)
    return rows.groupBy("id").applyInPandasWithState(
        process, "id string, begun long, ended long, outcome string", "begun long, ended long", "append", GroupStateTimeout.EventTimeTimeout
    )


def batches_of(n, rng):
    return [
        [(f"c{rng.randrange(60)}", rng.choice(["begin", "end"]), 1_000_000 + 4000 * k + rng.randrange(1, 9000)) for _ in range(40)] for k in range(n)
    ] + [[("last", "begin", 90_000_000)]]


def run(spark, batches, calls, **options):
    table = spark.createDataFrame([(k, i, p, ms) for k, b in enumerate(batches) for i, p, ms in b], "batch int, id string, phase string, ms long")
    table = table.withColumn("at", F.timestamp_millis("ms")).drop("ms")
    stream = runner.replayed(spark, table, files_per_batch=1, files=len(batches), order="batch")
    return rows(runner.to_table(calls(stream.drop("batch"), AFTER_S, **options), "calls"))


def test_shares_of_calls_give_what_single_calls_give(spark):
    batches = batches_of(5, random.Random(6))
    want = run(spark, batches, single_calls)
    assert {w[3] for w in want} == {"done", "abandoned", "orphan"}
    assert run(spark, batches, state.calls_in_flight, shares=3) == want
    assert run(spark, batches, state.calls_in_flight) == want


def test_the_groups_of_the_stream_do_not_grow_with_the_calls(spark):
    """Each group costs Python about a millisecond: 60 000 calls took a minute and more as groups of their own."""
    table = spark.range(60_000).select(
        F.format_string("c%d", "id").alias("id"), F.lit("begin").alias("phase"), F.timestamp_millis(F.col("id") + 1).alias("at")
    )
    stream = state.calls_in_flight(runner.replayed(spark, table))
    assert "share" in stream._jdf.queryExecution().logical().toString()
    end = spark.createDataFrame([("last", "begin")], "id string, phase string").withColumn("at", F.timestamp_millis(F.lit(10**10)))
    got = runner.to_table(state.calls_in_flight(runner.replayed(spark, table.unionByName(end))), "many")
    assert got.filter("id != 'last'").groupBy("outcome").count().collect() == [("abandoned", 60_000)]
