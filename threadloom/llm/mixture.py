"""Mixing sources to target weights along a curriculum.

Every source has a weight schedule over the progress of training, from 0 to 1. Its integral, times the total, is the
source's cumulative demand in tokens. The documents of a source, in a random but fixed order and repeated as often as needed
and allowed, supply tokens one after the other; inverting the demand at the middle of a document gives its training
position, and all sources are sorted by position, by range.

A schedule is a line through points (progress, weight), scaled so that its integral is the source's target share. ``schedules`` gives
the points; sources without any get the straight line from ``1 - tilt`` to ``1 + tilt``, with tilts chosen so that the weights of all
sources add up to 1 at every moment: sources that may be repeated more often (small, curated) become more frequent towards
the end. A source that runs out, at its largest number of repeats, follows its schedule until then.

Scale: the order within a source is a running sum over ranges, so a source with a third of all documents is spread out. The
targets are a small table, whose size is checked before it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.operators.prefix_sum import running_totals

#: The largest tilt of a source in the default curriculum.
TILT = 0.5
MOST_SOURCES = 10_000


def plan(targets: DataFrame, supply: DataFrame, total: int | None = None, tilt: float = TILT, schedules: DataFrame | None = None) -> DataFrame:
    """(source, share, max_repeats, knots, weights, filled, supply, wanted, demand) of each target; filled is the integral of the weights up to
    each knot, 1 in the end.

    supply is the tokens of the source's documents, wanted share * total, demand what can be used: at most max_repeats times supply.
    ``total`` is the mixture's size in tokens, by default the tokens of all documents of the targets' sources. Targets whose share is null or not
    above 0
    take no part. A null max_repeats counts as 1. A source without documents has demand 0. ``schedules`` has points (source, at, weight); those with a
    null, a negative weight or outside 0 to 1 don't count, of several at one place the largest weight does, and before the first and after the
    last point the weight
    stays as it is there. A schedule without any weight above 0 is none.
    """
    if schedules is not None and schedules.limit(100 * MOST_SOURCES + 1).count() > 100 * MOST_SOURCES:
        raise ValueError(f"more than {100 * MOST_SOURCES} points of schedules")
    points: dict[str, dict[float, float]] = {}
    if schedules is not None:
        for r in schedules.filter(
            "source IS NOT NULL AND at BETWEEN 0 AND 1 AND weight >= 0"
        ).groupBy("source", "at").agg(F.max("weight").alias("weight")).collect():
            points.setdefault(r["source"], {})[r["at"]] = r["weight"]
    if targets.limit(MOST_SOURCES + 1).count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    rows = targets.filter("source IS NOT NULL AND target_share > 0").groupBy("source").agg(
        F.sum("target_share").alias("share"), F.coalesce(F.min("max_repeats"), F.lit(1)).alias("max_repeats")
    )
    rows = rows.join(supply, "source", "left").withColumn("supply", F.coalesce("supply", F.lit(0).cast("long")))
    rows = [r.asDict() for r in rows.orderBy("source").collect()]
    size = sum(r["supply"] for r in rows) if total is None else total
    weight = sum(r["share"] for r in rows) or 1.0
    mean = sum(r["share"] * r["max_repeats"] for r in rows) / weight
    spread = max((abs(r["max_repeats"] - mean) for r in rows), default=0) or 1.0
    out = []
    for r in rows:
        wanted = r["share"] / weight * size
        lean = tilt * (r["max_repeats"] - mean) / spread
        line = points.get(r["source"], {})
        knots, weights, filled = integrated(line if any(line.values()) else {0.0: 1 - lean, 1.0: 1 + lean})
        out.append(
            (
                r["source"], r["share"], r["max_repeats"], knots, weights, filled, r["supply"], wanted,
                float(min(wanted, r["supply"] * r["max_repeats"]))
            )
        )
    kind = "array<double>"
    return targets.sparkSession.createDataFrame(
        out, f"source string, share double, max_repeats int, knots {kind}, weights {kind}, filled {kind}, supply long, wanted double, demand double"
    )


def integrated(line: dict[float, float]) -> tuple[list[float], list[float], list[float]]:
    """Knots from 0 to 1, weights there and the integral up to each, scaled to 1 in the end."""
    at = sorted(line)
    knots = [0.0] * (at[0] > 0) + at + [1.0] * (at[-1] < 1)
    weights = [line[at[0]]] * (at[0] > 0) + [line[x] for x in at] + [line[at[-1]]] * (at[-1] < 1)
    filled = [0.0]
    for i in range(1, len(knots)):
        filled.append(filled[-1] + (knots[i] - knots[i - 1]) * (weights[i] + weights[i - 1]) / 2)
    return knots, [w / filled[-1] for w in weights], [x / filled[-1] for x in filled]


def position(fraction: Column, knots: Column, weights: Column, filled: Column) -> Column:
    """The progress u at which a source has used ``fraction`` of its tokens: where the integral of its schedule is that large."""
    piece = F.greatest(F.lit(1), F.least(F.size(F.filter(filled, lambda x: x < fraction)), F.size(knots) - 1))  # counted from 1
    of = lambda column, k: F.element_at(column, piece + k)
    width, low, high = of(knots, 1) - of(knots, 0), of(weights, 0), of(weights, 1)
    rest = F.greatest(fraction - of(filled, 0), F.lit(0.0))
    # low * x + (high - low) / (2 * width) * x^2 = rest, in the form that bears equal weights
    root = F.sqrt(F.greatest(low * low + 2 * (high - low) * rest / width, F.lit(0.0)))
    return F.least(of(knots, 0) + F.coalesce(F.try_divide(2 * rest, low + root), F.lit(0.0)), F.lit(1.0))


def mixture(
    documents: DataFrame, targets: DataFrame, total: int | None = None, tilt: float = TILT, seed: int = 0, schedules: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Uses (doc, source, pass, tokens, position), in order of position over the partitions, and the plan.

    ``documents`` has (doc long, source string, tokens long), staged. Documents with a null id or source, without a target or without tokens aren't
    used; a document id should come once (each row is a document). A document is used if the middle of its tokens lies within the demand, so a
    source differs from
    its demand by less than half a document. pass counts the repetitions of the source from 0.
    """
    docs = documents.select("doc", "source", "tokens").filter("doc IS NOT NULL AND source IS NOT NULL AND tokens > 0")
    goal = plan(targets, docs.groupBy("source").agg(F.sum("tokens").alias("supply")), total, tilt, schedules)
    used = docs.join(F.broadcast(goal.filter("demand > 0").select("source", "knots", "weights", "filled", "wanted", "demand")), "source")
    ordered = running_totals(
        used.withColumn("shuffled", F.xxhash64("doc", F.lit(seed))), ["source"], ["shuffled", "doc"], "tokens", total="end", whole="once"
    )
    middle = F.col("end") - F.col("tokens") / F.lit(2)
    passes = F.sequence(F.lit(0).cast("long"), F.floor(F.col("demand") / F.col("once")))
    rows = ordered.withColumn("pass", F.explode(passes)).withColumn(
        "at", F.col("pass") * F.col("once") + middle
    ).filter(F.col("at") <= F.col("demand"))
    rows = rows.select(
        "doc", "source", "pass", "tokens",
        position(F.col("at") / F.col("wanted"), F.col("knots"), F.col("weights"), F.col("filled")).alias("position")
    )
    return rows.repartitionByRange("position", "source", "doc", "pass").sortWithinPartitions("position", "source", "doc", "pass"), goal


def shares(uses: DataFrame, goal: DataFrame) -> DataFrame:
    """(source, target_share, wanted_tokens, tokens, actual_share, documents, max_used, supply): the mixture as it came out."""
    got = uses.groupBy("source").agg(
        F.sum("tokens").alias("tokens"), F.countDistinct("doc").alias("documents"), (F.max("pass") + 1).alias("max_used")
    )
    rows = goal.join(got, "source", "left").na.fill(0, ["tokens", "documents", "max_used"])
    rows = rows.withColumn("all_tokens", F.sum("tokens").over(W.partitionBy(F.lit(1))))  # a row per target, of which there are few
    return rows.select(
        "source", F.col("share").alias("target_share"), F.col("wanted").alias("wanted_tokens"), "tokens",
        F.try_divide(F.col("tokens"), F.col("all_tokens")).alias("actual_share"), "documents", "max_used", "supply"
    )
