"""Overlap sizes between many large sets of identifiers.

Every set is cut into ranges of identifiers, and each piece is kept as a sorted run, delta-encoded as variable-length
bytes. For a pair of sets and a range the two runs are intersected by a linear merge where their sizes are similar
and by galloping (exponential search of the short run's values in the long one) where they aren't; the counts of
the ranges add up to the overlap. No intersection is ever written out.

Which pairs are looked at follows from the least similarity asked for, without loss: sets of Jaccard similarity
t share an identifier within the first ``n - ceil(t * n) + 1`` of either, identifiers being ordered from those in few
sets to those in many; pairs whose sizes or remaining lengths rule the similarity out are left off. At t = 0 nothing
can be left off: sets meet at each identifier they share, and these meetings, added up before they move, are the overlap.

Scale: a run holds at most ``RANGE`` identifiers whatever the size of its set, so a set with a third of all rows is
spread over its ranges. An identifier in very many sets comes last in every set and hardly ever into a prefix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.prefix_sum import running_totals
from threadloom.staging import stage

RANGE = 1 << 16
#: From this ratio of sizes on, the longer run is searched instead of merged.
GALLOP_FROM = 16


def encode_run(ids: np.ndarray) -> bytes:
    """Sorted distinct identifiers from 0 to below RANGE as variable-length deltas, 7 bits a byte, low bits first."""
    deltas = np.diff(np.asarray(ids, dtype=np.int64), prepend=0)
    if not len(deltas):
        return b""
    size = 1 + (deltas >= 1 << 7) + (deltas >= 1 << 14)
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]), dtype=np.uint8)
    for k in range(3):
        has = size > k
        more = size[has] > k + 1
        out[(end - size)[has] + k] = ((deltas[has] >> (7 * k)) & 127) | (more.astype(np.int64) << 7)
    return out.tobytes()


def decode_run(run: bytes) -> np.ndarray:
    raw = np.frombuffer(run, dtype=np.uint8).astype(np.int64)
    if not len(raw):
        return raw
    last = raw < 128
    start = np.r_[0, np.flatnonzero(last)[:-1] + 1]
    place = np.arange(len(raw)) - np.repeat(start, np.diff(np.r_[start, len(raw)]))
    return np.cumsum(np.add.reduceat((raw & 127) << (7 * place), start))


def gallop(short: np.ndarray, long: np.ndarray) -> int:
    """How many of the short run's values the long one has; for all values at once, windows double until they reach past the value."""
    low, step = np.zeros(len(short), dtype=np.int64), 1
    high = np.zeros(len(short), dtype=np.int64)
    going = np.ones(len(short), dtype=bool)
    n = len(long)
    while going.any():
        at = np.minimum(high[going], n - 1)
        past = (long[at] >= short[going]) | (high[going] >= n - 1)
        index = np.flatnonzero(going)
        low[index[~past]] = high[index[~past]]
        high[index[~past]] = np.minimum(high[index[~past]] + step, n - 1)
        going[index[past]] = False
        step *= 2
    while (low < high).any():  # binary search within the windows
        middle = (low + high) // 2
        less = long[middle] < short
        low, high = np.where(less, np.minimum(middle + 1, high), low), np.where(less, high, middle)
    return int((long[low] == short).sum())


def merge(a: np.ndarray, b: np.ndarray) -> int:
    """Linear merge: of two runs without repeats, values that come twice in the merged run are shared."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")  # of two sorted runs, this is a merge
    return int((both[1:] == both[:-1]).sum())


def intersect_count(a: np.ndarray, b: np.ndarray, gallop_from: int = GALLOP_FROM) -> int:
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not len(short) or short[0] > long[-1] or long[0] > short[-1]:
        return 0
    return gallop(short, long) if len(long) >= gallop_from * len(short) else merge(short, long)


def large_sets(sets: DataFrame, least: int) -> DataFrame:
    """(grp, sid, id, n) rows of sets with ``least`` identifiers or more; (grp, sid, id) must be distinct."""
    sizes = sets.groupBy("grp", "sid").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return sets.join(sizes, ["grp", "sid"])


def runs(sets: DataFrame) -> DataFrame:
    """(grp, sid, part, run): the delta-encoded runs of every set, by range of identifiers."""
    low = F.pmod(F.col("id"), F.lit(RANGE)).cast("int")
    lists = sets.groupBy("grp", "sid", F.floor(F.col("id") / F.lit(RANGE)).alias("part")).agg(F.array_sort(F.collect_list(low)).alias("ids"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            values, at = ids.values.to_numpy(), ids.offsets.to_numpy()
            coded = pa.array([encode_run(values[i:j]) for i, j in zip(at[:-1], at[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), coded], names=["grp", "sid", "part", "run"])

    return lists.select("grp", "sid", "part", "ids").mapInArrow(encode, "grp string, sid long, part long, run binary")


def candidate_pairs(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(grp, a, b, na, nb): pairs of sets that can have Jaccard similarity num/den, the smaller set id first. ``sets`` has n."""
    spread = sets.groupBy("grp", "id").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    # Identifiers of one set only come first in its order; as many places are left open for them.
    shared = sets.join(spread, ["grp", "id"])
    summed = running_totals(
        shared.select("grp", "sid", "n", "df", "id").withColumn("one", F.lit(1).cast("long")), ["grp", "sid"], ["df", "id"], "one", total="rank",
        whole="common"
    )
    place = F.col("n") - F.col("common") + F.col("rank")  # from 1
    prefix = summed.withColumn("place", place).filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * num / F.lit(den)) + 1)
    a, b = (prefix.select("grp", "id", *[F.col(c).alias(f"{c}_{s}") for c in ("sid", "n", "place")]) for s in "ab")
    need = F.ceil((F.col("n_a") + F.col("n_b")) * num / F.lit(num + den))
    still = F.lit(1) + F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    fits = (F.col("sid_a") < F.col("sid_b")) & (F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num) & (still >= need)
    return a.join(b, ["grp", "id"]).filter(fits).select(
        "grp", F.col("sid_a").alias("a"), F.col("sid_b").alias("b"), F.col("n_a").alias("na"), F.col("n_b").alias("nb")
    ).distinct()


def count_shared(pairs: DataFrame, coded: DataFrame, gallop_from: int = GALLOP_FROM) -> DataFrame:
    """Add ``shared`` to (grp, a, b, na, nb), by intersecting the runs of each range. Pairs that share nothing are left out."""
    a = coded.select("grp", F.col("sid").alias("a"), "part", F.col("run").alias("run_a"))
    b = coded.select("grp", F.col("sid").alias("b"), "part", F.col("run").alias("run_b"))
    both = pairs.join(a, ["grp", "a"]).join(b, ["grp", "b", "part"]).select("grp", "a", "b", "na", "nb", "run_a", "run_b")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, np.ndarray] = {}
        for batch in batches:
            n = []
            for x, y in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist()):
                if len(held) > 512:
                    held.clear()
                one = held[x] if x in held else held.setdefault(x, decode_run(x))
                two = held[y] if y in held else held.setdefault(y, decode_run(y))
                n.append(intersect_count(one, two, gallop_from))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(n, pa.int64())], names=["grp", "a", "b", "na", "nb", "shared"])

    parts = both.mapInArrow(count, "grp string, a long, b long, na long, nb long, shared long")
    return parts.groupBy("grp", "a", "b", "na", "nb").agg(F.sum("shared").alias("shared")).filter("shared > 0")


def every_overlap(sets: DataFrame) -> DataFrame:
    """(grp, a, b, na, nb, shared) of every pair of sets that shares an identifier. ``sets`` has n."""
    a, b = (sets.select("grp", "id", F.col("sid").alias(s), F.col("n").alias(f"n{s}")) for s in "ab")
    return a.join(b, ["grp", "id"]).filter("a < b").groupBy("grp", "a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("shared"))


def overlaps(sets: DataFrame, least: int, num: int, den: int) -> DataFrame:
    """(grp, a, b, na, nb, shared): pairs a < b of sets of one group with Jaccard similarity num/den or more that share an identifier.

    ``sets`` has rows (grp string, sid long, id long); repeated rows count once, rows with a null are left out, other columns are
    ignored. Sets with fewer than ``least`` identifiers are left out. An empty table gives an empty one.
    """
    clean = sets.select("grp", "sid", "id").filter("grp IS NOT NULL AND sid IS NOT NULL AND id IS NOT NULL").distinct()
    big = stage(large_sets(clean, least), "large-sets")
    if not num:
        return every_overlap(big)
    pairs = candidate_pairs(big, num, den)
    counted = count_shared(pairs, runs(big))
    return counted.filter(F.col("shared") * den >= (F.col("na") + F.col("nb") - F.col("shared")) * num)
