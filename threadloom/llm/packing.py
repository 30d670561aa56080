"""Filling containers of fixed capacity with items of varying size, as little space as possible left unused.

The items are spread over partitions, and each partition is packed by best-fit decreasing. Lower bounds from
dual-feasible functions certify the number of bins: of a partition, by its own items, and of all of them, by the counts of
sizes. As long as the whole isn't certified, the partitions keep their full bins, exchange the documents of the others
among each other, and are packed again, over fewer partitions each round, until the bound is met, one partition holds all
that is left or a round saves no bin.

An item larger than the capacity is cut into pieces of the capacity and a rest; no other item is ever split.

Scale: a partition holds about ``items_per_part`` items whatever the input; only what lies in unfilled bins moves again. Sizes are numbers of tokens,
so texts are read once and never shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.frames import plain_strings
from threadloom.staging import stage

ITEMS_PER_PART = 100_000
MOST_CONTAINERS = 1000
#: Bins filled to this share are kept when a partition exchanges documents.
FULL = 0.999


def best_fit_decreasing(sizes: Sequence[int], capacity: int) -> np.ndarray:
    """The bin of every item, items taken from large to small and put where least room remains."""
    order = np.argsort(-np.asarray(sizes, dtype=np.int64), kind="stable")
    bins = np.empty(len(order), dtype=np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms: list[int] = []  # rising amounts of room that some bin has
    count = 0
    for i in order.tolist():
        size = int(sizes[i])
        at = bisect_left(open_rooms, size)
        if at < len(open_rooms):
            left = open_rooms[at]
            b = room[left].pop()
            if not room[left]:
                open_rooms.pop(at)
        else:
            left, b = capacity, count
            count += 1
        bins[i] = b
        left -= size
        if left:
            if not room[left]:
                insort(open_rooms, left)
            room[left].append(b)
    return bins


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, by dual-feasible functions: for each, the transformed sizes are added up.

    The functions are the identity, the threshold function (sizes above capacity - k count as whole, sizes below k
    as nothing) and the rounding function floor((m + 1) * x) / m; all keep every feasible bin at 1 or less.
    """
    values, counts = np.unique(np.asarray(sizes, dtype=np.int64), return_counts=True)
    return bound_of_counts(values, counts, capacity)


def bound_of_counts(values: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """The lower bound for ``counts`` items of each of the sizes ``values``."""
    if not len(values):
        return 0
    order = np.argsort(values)
    values, counts = values[order].astype(np.int64), counts[order].astype(np.int64)
    best = -(-int((values * counts).sum()) // capacity)
    falling = np.cumsum((values * counts)[::-1])[::-1]
    above = np.cumsum(counts[::-1])[::-1]
    for k in values[(values > 0) & (values * 2 <= capacity)].tolist():
        lo, hi = np.searchsorted(values, k), np.searchsorted(values, capacity - k, side="right")
        whole = int(above[hi]) if hi < len(values) else 0
        between = int(falling[lo] - (falling[hi] if hi < len(values) else 0)) if lo < len(values) else 0
        best = max(best, whole + -(-between // capacity))
    for m in range(1, 21):
        grown = (m + 1) * values
        scaled = np.where(grown % capacity == 0, m * values, (grown // capacity) * capacity)  # in units of 1 / (m * capacity)
        best = max(best, -(-int((scaled * counts).sum()) // (m * capacity)))
    return best


def _pack(frame: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Add bin, bin_tokens and state: ``final`` for items that stay, ``again`` for items that are exchanged."""
    sizes = frame["tokens"].to_numpy()
    bins = best_fit_decreasing(sizes, capacity)
    used = np.bincount(bins, weights=sizes).astype(np.int64)
    stays = used >= FULL * capacity
    out = frame.assign(bin=bins, bin_tokens=used[bins], final=stays[bins])
    out["part_bins"], out["part_bound"], out["part_stays"] = len(used), lower_bound(sizes, capacity), int(stays.sum())
    return out


def least_bins(todo: DataFrame) -> dict[str, int]:
    """The certified least number of bins of each container, from how often each size comes (as many rows as sizes)."""
    counts = todo.groupBy("container", "capacity", "tokens").agg(F.count(F.lit(1)).alias("n"))

    def bound(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "container": [frame["container"].iloc[0]],
                "least": [bound_of_counts(frame["tokens"].to_numpy(), frame["n"].to_numpy(), int(frame["capacity"].iloc[0]))]
            }
        )

    return {r["container"]: r["least"] for r in counts.groupBy("container").applyInPandas(bound, "container string, least long").collect()}


def _packed_part(frame: pd.DataFrame) -> pd.DataFrame:
    return _pack(plain_strings(frame).sort_values(["item", "piece"], kind="stable").reset_index(drop=True), int(frame["capacity"].iloc[0]))


def pieces(items: DataFrame, containers: DataFrame) -> DataFrame:
    """(container, capacity, item, piece, tokens): every item for every container, cut where it is larger than that.

    Items of size 0, and nulls in item or tokens, give no pieces. ``containers`` is a small table of up to MOST_CONTAINERS names, each with its
    largest capacity.
    """
    kinds = containers.filter(
        "container IS NOT NULL AND capacity > 0"
    ).groupBy("container").agg(F.max("capacity")).limit(MOST_CONTAINERS + 1).collect()
    if len(kinds) > MOST_CONTAINERS:
        raise ValueError(f"more than {MOST_CONTAINERS} containers")
    kind = F.array(
        *[F.struct(F.lit(r[0]).alias("container"), F.lit(r[1]).cast("int").alias("capacity")) for r in sorted(kinds)]
    ).cast("array<struct<container:string,capacity:int>>")
    both = items.filter("item IS NOT NULL AND tokens > 0").select("item", "tokens", F.inline(kind))
    n = F.ceil(F.col("tokens") / F.col("capacity"))
    rows = both.select("container", "capacity", "item", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("piece"))
    return rows.withColumn("tokens", F.least(F.col("capacity").cast("long"), F.col("tokens") - F.col("piece") * F.col("capacity")))


def pack(items: DataFrame, containers: DataFrame, items_per_part: int = ITEMS_PER_PART) -> DataFrame:
    """(container, capacity, bin, item, piece, tokens, bin_tokens, unused, part_bins, part_bound, least_bins, round) of all pieces.

    ``items`` has (item long, tokens long), ``containers`` (container string, capacity int). bin is unique within a container. part_bins and
    part_bound are the bins and the certified least number of bins of the partition that packed the piece in its last round, least_bins is
    the certified least number of bins of the container over all pieces. Items repeated in the input are packed as often as they come. An
    empty input gives an empty table.
    """
    todo = stage(pieces(items, containers), "pieces")
    whole = todo.filter("tokens = capacity")  # fills a bin by itself
    todo = todo.filter("tokens < capacity")
    alone = {r["container"]: r["count"] for r in whole.groupBy("container").count().collect()}
    least, kept, before = least_bins(todo), Counter(), {}
    done: list[DataFrame] = []
    schema = "container string, capacity int, item long, piece long, tokens long, part long, bin long, bin_tokens long, final boolean, part_bins long, part_bound long, part_stays long"
    turn, going = 1, bool(least)
    while going:
        sizes = todo.groupBy("container").count()
        parts = F.ceil(F.col("count") / F.lit(items_per_part)).cast("long")
        spread = todo.join(F.broadcast(sizes), "container").withColumn("part", F.pmod(F.xxhash64("item", "piece", F.lit(turn)), parts)).drop("count")  # a row per container
        packed = stage(
            spread.select(
                "container", "capacity", "item", "piece", "tokens", "part"
            ).groupBy("container", "part").applyInPandas(_packed_part, schema),
            "packed"
        )
        per_part = packed.groupBy("container", "part").agg(F.max("part_bins").alias("bins"), F.max("part_stays").alias("stays"))
        settled, going = [], False
        for r in per_part.groupBy("container").agg(
            F.count(F.lit(1)).alias("parts"), F.sum("bins").alias("bins"), F.sum("stays").alias("stays")
        ).collect():
            name = r["container"]
            bins = kept[name] + r["bins"]
            if r["parts"] == 1 or bins <= least[name] or bins >= before.get(name, bins + 1):
                settled.append(name)
            elif r["stays"] < r["bins"]:
                going = True
            before[name] = bins
            kept[name] += r["stays"]
        stays = F.col("final") | F.col("container").isin(settled)
        done.append(packed.filter(stays).withColumn("round", F.lit(turn)))
        todo = packed.filter(~stays).select("container", "capacity", "item", "piece", "tokens")
        turn += 1
    out = whole.withColumns(
        {
            "part": F.col("piece"), "bin": F.col("piece"), "bin_tokens": F.col("tokens"), "part_bins": F.lit(1).cast("long"),
            "part_bound": F.lit(1).cast("long"), "round": F.lit(0)
        }
    )
    cols = ["container", "capacity", "item", "piece", "tokens", "bin_tokens", "part_bins", "part_bound", "round"]
    name = F.concat_ws("-", "round", "part", "bin")
    out = out.select(*cols, F.concat_ws("-", F.lit("whole"), "item", "piece").alias("bin"))
    for d in done:
        out = out.unionByName(d.select(*cols, name.alias("bin")))
    certified = F.lit(0).cast("long")
    for c in {*alone, *least}:
        certified = F.when(F.col("container") == c, alone.get(c, 0) + least.get(c, 0)).otherwise(certified)
    return out.withColumns({"unused": F.col("capacity") - F.col("bin_tokens"), "least_bins": certified.cast("long")})


def filling(packed: DataFrame) -> DataFrame:
    """(container, capacity, bins, pieces, tokens, unused, least_bins): what each kind of container came to, beside the certified least number of
    bins."""
    per_bin = packed.groupBy("container", "capacity", "bin").agg(
        F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("tokens"), F.max("least_bins").alias("least")
    )
    rows = per_bin.groupBy("container", "capacity").agg(
        F.count(F.lit(1)).alias("bins"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), F.max("least").alias("least_bins")
    )
    return rows.withColumn("unused", F.col("bins") * F.col("capacity") - F.col("tokens"))
