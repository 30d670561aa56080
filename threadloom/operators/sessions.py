"""Sessions: activity of a user, device or project split where it falls silent.

The operator is a keyed stream with timers. Per key it holds the open sessions; every update, taken in
order of time, opens a session or extends one and resets its inactivity timer, and a timer that expires
emits the session's start, end and number of events. ``sessions_stream`` runs it on any streaming
DataFrame; ``sessions`` drives a finite table through the same operator, slice of time by slice of time, so that
timers of one slice expire while the next is read and the state holds what is open, not the whole past.

Scale: before the stream, ``sessions`` collapses the events of one key that fall into one slot as wide as
the allowed gap. Two events in a slot are never further apart than the gap, so they always belong to one
session and the collapse is exact. It is an ordinary partial aggregation, which means that a key with a
third of all rows reaches the stateful operator as one row per slot of its time span, not one per event.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from threadloom.staging import make_folder, move_folder, new_path, stage

GAP_MS = 1_800_000
STATE = T.StructType([T.StructField(n, T.ArrayType(T.LongType(), False)) for n in ("starts", "ends", "counts")])
#: Micro-batches that a finite table is read in.
SLICES = 3
#: The stream's clock starts at 1970 and ends in 2262. Times keep their value; only the clock, by which timers expire, is shifted, and stands nearly
#: still (1 ms a slice)
#: outside the years 1831 to 2109: sessions there are emitted later, those after 2109 at the end of input.
LATEST_MS, SHIFT_MS, END_OF_INPUT_MS = 4_400_000_000_000, 4_500_000_000_000, 9_000_000_000_000


def merge_updates(starts: np.ndarray, ends: np.ndarray, counts: np.ndarray, gap_ms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sessions of one key from updates in any order; more than ``gap_ms`` of silence starts a new one."""
    order = np.lexsort((ends, starts))
    starts, ends, counts = starts[order], ends[order], counts[order]
    reach = np.maximum.accumulate(ends)
    first = np.flatnonzero(np.r_[True, starts[1:] - reach[:-1] > gap_ms])
    last = np.r_[first[1:], len(starts)] - 1
    return starts[first], reach[last], np.add.reduceat(counts, first)


def session_processor(gap_ms: int, key_names: Sequence[str], shift_ms: int = 0):
    """The state function: ordered updates extend sessions, expired timers emit them. ``shift_ms`` is the clock's lead over the times."""

    def emit(key: tuple, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({**{n: [k] * len(starts) for n, k in zip(key_names, key)}, "start_ms": starts, "end_ms": ends, "n_events": counts})

    def due(ends: np.ndarray) -> np.ndarray:
        """When timers expire, by the stream's clock."""
        if not shift_ms:
            return ends + gap_ms + 1
        return np.where(ends > LATEST_MS, END_OF_INPUT_MS - 1, np.minimum(np.maximum(ends, -LATEST_MS) + shift_ms + gap_ms + 1, END_OF_INPUT_MS - 1))

    def process(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [[np.asarray(x, dtype=np.int64)] for x in (state.get if state.exists else ([], [], []))]
        if not state.hasTimedOut:
            for frame in frames:
                for x, c in zip(held, ("start_ms", "end_ms", "n_events")):
                    x.append(frame[c].to_numpy(dtype=np.int64))
        starts, ends, counts = (np.concatenate(x) for x in held)
        if not state.hasTimedOut and len(starts):
            starts, ends, counts = merge_updates(starts, ends, counts, gap_ms)
        timers = due(ends)
        expired = timers <= state.getCurrentWatermarkMs()
        if expired.any():
            yield emit(key, starts[expired], ends[expired], counts[expired])
        if not expired.all():
            state.update(tuple(x[~expired].tolist() for x in (starts, ends, counts)))
            state.setTimeoutTimestamp(int(timers[~expired].min()))
        elif state.exists:
            state.remove()

    return process


def sessions_stream(updates: DataFrame, keys: Sequence[str], gap_ms: int = GAP_MS, delay: str = "0 seconds", shift_ms: int = 0) -> DataFrame:
    """Sessions from a streaming DataFrame with ``keys``, start_ms, end_ms, n_events and event_time (for the watermark).

    A raw event is an update with start_ms = end_ms and n_events = 1. Events that arrive up to ``delay`` late,
    and all events within one micro-batch, may come in any order. A session is emitted once, when the
    watermark passes its inactivity timer.
    """
    out = T.StructType([updates.schema[k] for k in keys] + [T.StructField(n, T.LongType()) for n in ("start_ms", "end_ms", "n_events")])
    return (
        updates.withWatermark("event_time", delay)
        .groupBy(*keys)
        .applyInPandasWithState(session_processor(gap_ms, keys, shift_ms), out, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )


def sessions(events: DataFrame, keys: Sequence[str], time_ms: str, gap_ms: int = GAP_MS, slices: int = SLICES) -> DataFrame:
    """All sessions of a finite table of events: ``keys``, start_ms, end_ms, n_events.

    Rows without a time are left out. Any whole number of milliseconds is a time. A null key is a key of its own. Ties in time belong to one session.
    Rows that repeat count as often as they come: remove repeated deliveries before. Other columns are
    ignored, whatever their names. An empty table gives an empty one.
    """
    spark = events.sparkSession
    gap = int(gap_ms)
    named = [f"k{i}" for i in range(len(keys))]
    rows = events.select(
        *[F.col(f"`{k}`").alias(n) for k, n in zip(keys, named)], F.col(f"`{time_ms}`").cast("long").alias("ms")
    ).filter("ms IS NOT NULL")
    slots = rows.groupBy(*named, F.floor(F.col("ms") / F.lit(max(gap, 1))).alias("slot")).agg(
        F.min("ms").alias("start_ms"), F.max("ms").alias("end_ms"), F.count(F.lit(1)).alias("n_events")
    )
    slots = stage(slots, "session-slots")
    # Slices are cut between slots, so no event of a slice is older than the watermark of the one before.
    cuts = slots.agg(F.percentile_approx("slot", [i / slices for i in range(1, slices)], 1000)).first()[0] or [] if slices > 1 else []
    piece = reduce(lambda x, y: x + y, [F.when(F.col("slot") > c, 1).otherwise(0) for c in cuts], F.lit(0))
    latest = F.lit(LATEST_MS).cast("long")
    clock = F.least(F.greatest(F.col("end_ms"), -latest), latest) + SHIFT_MS + F.when(F.abs("end_ms") > latest, F.col("slice")).otherwise(0)
    fields = [T.StructField(n, rows.schema[n].dataType) for n in named] + [T.StructField(n, T.LongType()) for n in ("start_ms", "end_ms", "n_events")]
    last, none = F.lit(1 << 61).cast("long"), F.lit(0).cast("long")
    end = spark.range(1).select(
        *[F.lit(None).cast(rows.schema[n].dataType).alias(n) for n in named], last.alias("start_ms"), last.alias("end_ms"), none.alias("n_events")
    )
    end = end.withColumns({"slice": F.lit(len(cuts)), "event_time": F.timestamp_millis(F.lit(END_OF_INPUT_MS).cast("long"))})
    updates, inbox, checkpoint, out = (new_path(spark, x) for x in ("session-updates", "session-inbox", "session-state", "sessions"))
    timed = slots.withColumn("slice", piece).withColumn("event_time", F.timestamp_millis(clock)).drop("slot")
    timed.unionByName(end).write.partitionBy("slice").parquet(updates)
    make_folder(spark, inbox)
    schema = T.StructType([*fields, T.StructField("event_time", T.TimestampType())])
    for i in range(len(cuts) + 1):
        # The next slice is moved into the folder that the stream watches, and the stream goes on from its checkpoint.
        if not move_folder(spark, f"{updates}/slice={i}", f"{inbox}/part-{i}"):
            continue
        stream = sessions_stream(
            spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(inbox), named, gap, shift_ms=SHIFT_MS
        ).filter("n_events > 0")
        query = stream.writeStream.format("parquet").option(
            "checkpointLocation", checkpoint
        ).outputMode("append").trigger(availableNow=True).start(out)
        query.awaitTermination()
    done = spark.read.schema(T.StructType(fields)).parquet(out)
    return done.select(*[F.col(n).alias(k) for n, k in zip(named, keys)], "start_ms", "end_ms", "n_events")
