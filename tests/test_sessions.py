import random

from conftest import rows
from threadloom.operators.sessions import sessions
from threadloom.streaming.runner import replayed, to_table


def brute(events, gap):
    by = {}
    for k, ms in events:
        if ms is not None:
            by.setdefault(k, []).append(ms)
    out = []
    for k, times in by.items():
        times.sort()
        start = before = times[0]
        n = 0
        for t in times:
            if t - before > gap:
                out.append((k, start, before, n))
                start, n = t, 0
            n, before = n + 1, t
        out.append((k, start, before, n))
    return sorted(out, key=repr)


def run(spark, events, gap):
    df = spark.createDataFrame([(k, ms, "x") for k, ms in events], "k string, ms long, start_ms string")
    return rows(sessions(df, ["k"], "ms", gap))


def test_random_against_brute_force(spark):
    rng = random.Random(1)
    events = [(rng.choice(["a", "b", None, ""]), rng.randrange(0, 200_000)) for _ in range(3000)] + [("hot", t * 7) for t in range(20_000)]
    for gap in (0, 7, 100, 1000):
        assert run(spark, events, gap) == brute(events, gap)


def test_exactly_the_gap_stays_together(spark):
    assert run(spark, [("a", 0), ("a", 1000), ("a", 2001)], 1000) == [("a", 0, 1000, 2), ("a", 2001, 2001, 1)]


def test_nulls_ties_and_empty(spark):
    assert run(spark, [("a", None)], 10) == []
    assert run(spark, [], 10) == []
    assert run(spark, [("a", 5), ("a", 5), (None, 5)], 10) == [("a", 5, 5, 2), (None, 5, 5, 1)]


def test_times_far_from_now(spark):
    far = [("a", -5000), ("a", -4000)] + [(k, s * t * 10**12 + x) for k in "ab" for s in (-1, 1) for t in (5, 9, 300, 8000) for x in (0, 1500, 4000)]
    assert run(spark, far, 2000) == brute(far, 2000)


def test_sessions_across_slices_and_timers_that_expire_between_them(spark):
    rng = random.Random(3)
    events = [("long", t * 900) for t in range(3000)] + [(f"k{rng.randrange(40)}", rng.randrange(3_000_000)) for _ in range(2000)]
    df = spark.createDataFrame(events, "k string, ms long")
    for slices in (1, 2, 5):
        assert rows(sessions(df, ["k"], "ms", 1000, slices=slices)) == brute(events, 1000)


def test_late_events_within_the_delay_of_a_real_stream(spark):
    from pyspark.sql import functions as F

    from threadloom.operators.sessions import sessions_stream

    base = 1_700_000_000_000
    times = [0, 60_000, 30_000, 200_000, 100_000, 900_000, 905_000]  # out of order
    df = spark.createDataFrame(
        [("a", base + t, base + t, 1, i) for i, t in enumerate(times)] + [("end", base + 10**9, base + 10**9, 1, 99)],
        "k string, start_ms long, end_ms long, n_events long, seq long"
    )
    df = df.withColumn("event_time", F.timestamp_millis("end_ms"))
    stream = replayed(spark, df, files_per_batch=1, files=4, order="seq").drop("seq")
    got = rows(to_table(sessions_stream(stream, ["k"], 120_000, "1 hour"), "test-sessions"))
    assert [r for r in got if r[0] == "a"] == [("a", base, base + 200_000, 5), ("a", base + 900_000, base + 905_000, 2)]
