import math
import random

from conftest import rows
from threadloom.llm import percentiles as pc


def brute(data, p):
    by = {}
    for g, v in data:
        if v is not None and v == v:
            by.setdefault(g, []).append(v)
    return {g: (len(v), sorted(v)[(len(v) * p + 9999) // 10000 - 1]) for g, v in by.items()}


def run(spark, data, wanted, kind="long"):
    df = spark.createDataFrame([(g, v, 0) for g, v in data], f"g string, v {kind}, n int")
    return rows(pc.percentiles(pc.value_counts(df, ["g"], "v"), ["g"], wanted))


def test_random_against_sorting(spark):
    rng = random.Random(4)
    data = [
        (rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(50), rng.randrange(10**6)])) for _ in range(3000)
    ] + [("hot", i % 97) for i in range(5000)]
    for p in (1, 5000, 9500, 10000):
        assert run(spark, data, {"p": p}) == sorted(((g, n, v) for g, (n, v) in brute(data, p).items()), key=repr)


def test_doubles_nan_zero_and_empty(spark):
    assert run(
        spark, [("a", 0.0), ("a", -0.0), ("a", math.nan), ("a", None), ("a", math.inf)], {"p50": 5000, "p100": 10000}, "double"
    ) == [("a", 3, 0.0, math.inf)]
    assert run(spark, [], {"p50": 5000}) == []
    assert run(spark, [("a", None)], {"p50": 5000}) == []


def test_days_combine_to_the_whole(spark):
    rng = random.Random(5)
    data = [(str(i % 5), rng.randrange(1000)) for i in range(2000)]
    df = spark.createDataFrame([(d, "x", v) for d, v in data], "day string, g string, v long")
    apart = pc.combine(pc.value_counts(df, ["day", "g"], "v"), ["g"])
    assert rows(pc.percentiles(apart, ["g"])) == rows(pc.percentiles(pc.value_counts(df, ["g"], "v"), ["g"]))
