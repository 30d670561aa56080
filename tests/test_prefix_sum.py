import random

from conftest import rows
from threadloom.operators.prefix_sum import running_totals


def test_against_python(spark):
    rng = random.Random(20)
    data = [(rng.choice(["a", "b", None]), i, rng.choice([None, rng.randrange(10)])) for i in range(500)] + [("hot", i, 1) for i in range(5000)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "g string, k long, v long")
    sums, want = {}, []
    for g, k, v in sorted(data, key=lambda r: r[1]):
        sums[g] = sums.get(g, 0) + (v or 0)
        want.append((g, k, sums[g]))
    got = running_totals(df, ["g"], ["k"], "v")
    assert rows(got.select("g", "k", "running")) == sorted(want, key=repr)
    assert rows(got.select("g", "whole").distinct()) == sorted(sums.items(), key=repr)


def test_without_groups_and_empty(spark):
    df = spark.createDataFrame([(3, 1), (1, 5), (2, 0)], "k long, v long")
    assert rows(running_totals(df, [], ["k"], "v").select("k", "running", "whole")) == [(1, 5, 6), (2, 5, 6), (3, 6, 6)]
    assert running_totals(df.limit(0), [], ["k"], "v").count() == 0
