import random

import numpy as np
import pytest
from conftest import rows
from threadloom.llm import mixture as mx
from threadloom.llm import packing as pk
from threadloom.llm import tokens as tk


def test_best_fit_keeps_the_capacity_and_the_bound_holds():
    rng = random.Random(12)
    for _ in range(60):
        cap = rng.randrange(5, 200)
        sizes = [rng.randrange(1, cap + 1) for _ in range(rng.randrange(1, 120))]
        bins = pk.best_fit_decreasing(sizes, cap)
        used = np.bincount(bins, weights=sizes)
        assert used.max() <= cap and (used > 0).all()
        bound = pk.lower_bound(np.array(sizes), cap)
        assert bound <= len(used) <= bound * 1.25 + 2


def test_the_bound_is_never_above_the_best_packing():
    def optimum(sizes, cap):
        best = [len(sizes)]

        def go(i, rooms):
            if len(rooms) >= best[0]:
                return
            if i == len(sizes):
                best[0] = len(rooms)
                return
            for j, r in enumerate(rooms):
                if r >= sizes[i] and r not in rooms[:j]:
                    go(i + 1, rooms[:j] + [r - sizes[i]] + rooms[j + 1 :])
            go(i + 1, rooms + [cap - sizes[i]])

        go(0, [])
        return best[0]

    rng = random.Random(13)
    for _ in range(80):
        cap = rng.randrange(6, 30)
        sizes = sorted((rng.randrange(1, cap + 1) for _ in range(rng.randrange(1, 9))), reverse=True)
        assert pk.lower_bound(np.array(sizes), cap) <= optimum(sizes, cap)


def pack(spark, items, cap=100, **options):
    df = spark.createDataFrame([(i, t, "x") for i, t in items], "item long, tokens long, bin string")
    return pk.pack(df, spark.createDataFrame([("c", cap), (None, 5), ("zero", 0)], "container string, capacity int"), **options)


def test_every_token_once_and_only_large_items_split(spark):
    rng = random.Random(14)
    items = [(i, rng.choice([0, 1, 30, 55, 70, 99, 100, 101, 250])) for i in range(3000)] + [(None, 5), (7000, None)]
    out = pack(spark, items, items_per_part=200).collect()
    got, bins = {}, {}
    for r in out:
        got.setdefault(r.item, []).append(r.tokens)
        bins.setdefault(r.bin, []).append(r)
    want = {i: t for i, t in items if i is not None and t}
    assert {i: sum(v) for i, v in got.items()} == want
    assert all(len(v) == -(-want[i] // 100) for i, v in got.items())
    for rs in bins.values():
        total = sum(r.tokens for r in rs)
        assert total <= 100 and all(r.bin_tokens == total and r.unused == 100 - total for r in rs)
    least = -(-sum(want.values()) // 100)
    assert len(bins) <= 1.3 * least
    (line,) = pk.filling(pack(spark, items, items_per_part=200)).collect()
    assert line.bins == len(bins) and line.tokens == sum(want.values()) and least <= line.least_bins <= line.bins


def test_partitions_with_gaps_exchange(spark):
    items = [(i, 60 if i % 2 else 40) for i in range(2000)]
    one = pk.filling(pack(spark, items, items_per_part=50)).first()
    assert one.bins <= 1030  # 1000 is perfect; single partitions of 50 leave far more


def test_empty(spark):
    assert pack(spark, []).count() == 0 and pk.filling(pack(spark, [])).count() == 0


def test_long_texts_in_blocks_count_like_the_whole():
    text = "Some words, and numbers 12 34;  two spaces\n\nlines don't stop. " * 400
    encode = tk.encoder(tk.VOCABULARY).encode_ordinary
    for size in (50, 997, 10**6):
        assert "".join(tk.blocks(text, size)) == text
        assert sum(len(encode(b)) for b in tk.blocks(text, size)) == len(encode(text))
    assert tk.count_tokens(None) == tk.count_tokens("") == 0


def test_positions_invert_the_demand(spark):
    from pyspark.sql import functions as F

    for line in ({0.0: 1.5, 1.0: 0.5}, {0.0: 1.0}, {0.0: 0.1, 1.0: 1.9}, {0.2: 0.0, 0.5: 3.0, 0.7: 1.0}, {0.0: 0.0, 0.4: 0.0, 1.0: 2.0}):
        knots, weights, filled = mx.integrated(line)
        assert knots[0] == 0 and knots[-1] == 1 and abs(filled[-1] - 1) < 1e-12

        def used(u):
            total = 0.0
            for i in range(1, len(knots)):
                x = min(max(u - knots[i - 1], 0.0), knots[i] - knots[i - 1])
                total += weights[i - 1] * x + (weights[i] - weights[i - 1]) * x * x / (2 * (knots[i] - knots[i - 1]))
            return total

        us = [i / 20 for i in range(21)]
        df = spark.createDataFrame([(u, used(u)) for u in us], "u double, f double")
        arrays = [F.array(*[F.lit(float(x)) for x in xs]) for xs in (knots, weights, filled)]
        got = df.select("u", "f", mx.position(F.col("f"), *arrays).alias("v")).collect()
        assert all(abs(used(r.v) - r.f) < 1e-7 for r in got)


def test_schedules_and_a_source_that_runs_out(spark):
    docs = spark.createDataFrame(
        [(i, "a" if i % 2 else "b", 10) for i in range(2000)] + [(10_000 + i, "short", 10) for i in range(10)], "doc long, source string, tokens long"
    )
    targets = spark.createDataFrame([("a", 0.45, 4), ("b", 0.45, 4), ("short", 0.1, 2)], "source string, target_share double, max_repeats int")
    points = spark.createDataFrame(
        [("a", 0.0, 1.0), ("a", 0.5, 0.0), ("a", 1.0, 0.0), ("b", None, 1.0), ("b", 2.0, 1.0), ("short", 0.3, 5.0)],
        "source string, at double, weight double"
    )
    uses, goal = mx.mixture(docs, targets, total=20_000, tilt=0.0, schedules=points)
    got = uses.collect()
    assert max(r.position for r in got if r.source == "a") <= 0.5
    assert max(r.position for r in got if r.source == "b") > 0.99
    # 200 of the 2000 tokens wanted are there, so it ends after a tenth of the run
    assert sum(r.tokens for r in got if r.source == "short") == 200 and max(r.position for r in got if r.source == "short") < 0.1


def test_shares_caps_and_order(spark):
    rng = random.Random(15)
    docs = [(i, rng.choice(["a", "b", "b", "b", None, "other"]), rng.randrange(0, 50)) for i in range(3000)] + [(9001, "tiny", 100), (None, "a", 5)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc long, source string, tokens long, position string")
    targets = spark.createDataFrame(
        [("a", 0.5, 4), ("b", 0.3, 1), ("tiny", 0.1, 3), ("none", 0.1, 2), ("zero", 0.0, 2)], "source string, target_share double, max_repeats int"
    )
    uses, goal = mx.mixture(df, targets, total=40_000)
    lines = {r.source: r for r in mx.shares(uses, goal).collect()}
    assert abs(lines["a"].tokens - 20_000) <= 50 and abs(lines["b"].tokens - 12_000) <= 50
    assert lines["tiny"].tokens == 300 and lines["tiny"].max_used == 3 and lines["none"].tokens == 0 and "zero" not in lines
    got = uses.collect()
    assert all(0 <= r.position <= 1 for r in got) and len({(r.doc, r["pass"]) for r in got}) == len(got)
    assert abs(sum(r.actual_share for r in lines.values()) - 1) < 1e-9
    early = [r for r in got if r.position < 0.2]
    late = [r for r in got if r.position > 0.8]
    share = lambda rs, s: sum(r.tokens for r in rs if r.source == s) / sum(r.tokens for r in rs)
    assert share(late, "a") > share(early, "a")  # may be repeated more often, so it grows


def test_mixture_of_nothing(spark):
    df = spark.createDataFrame([], "doc long, source string, tokens long")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    uses, goal = mx.mixture(df, targets)
    assert uses.count() == 0 and mx.shares(uses, goal).first().tokens == 0


def test_too_many_containers(spark):
    many = spark.range(pk.MOST_CONTAINERS + 1).selectExpr("cast(id as string) container", "cast(id + 1 as int) capacity")
    with pytest.raises(ValueError):
        pk.pack(spark.createDataFrame([(1, 1)], "item long, tokens long"), many)
