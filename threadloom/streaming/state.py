"""Stateful streams: the log replayed, channel cursors, calls in flight, last touches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from threadloom.functions.names import channel_matches

ABANDONED_AFTER_S = 90


def live_entities(log: DataFrame) -> DataFrame:
    """(kind, name, path, value, ts, alive): the state of each entity of a mutation log as it streams in, an update per key and batch.

    Fields keep their last non-null value by (ts, line_no) and an entity is dead from a tombstone on that isn't older than its latest event: late
    and repeated lines change nothing that they shouldn't. This is an ordinary aggregation, which the engine keeps in its state store.
    """
    at = F.struct("ts", "line_no")
    own = F.col("op") == "entity"
    last = lambda c: F.max_by(c, F.when(own & F.col(c).isNotNull(), at)).alias(c)
    rows = log.filter(F.col("op").isin("entity", "tombstone"))
    out = rows.groupBy("kind", "name").agg(
        last("path"), last("value"), F.max(F.when(own, F.col("ts"))).alias("ts"), F.max(F.when(F.col("op") == "tombstone", F.col("ts"))).alias("dead")
    )
    return out.withColumn("alive", F.col("ts").isNotNull() & (F.col("dead").isNull() | (F.col("dead") < F.col("ts")))).drop("dead")


def channel_heads(messages: DataFrame, pattern: str = "*") -> DataFrame:
    """(channel, last_seq, active): the newest message of each channel and its active messages, updated as they come."""
    rows = messages.filter(channel_matches(F.col("channel"), pattern))
    return rows.groupBy("channel").agg(F.max("seq").alias("last_seq"), F.sum(F.when(F.col("status") == "active", 1).otherwise(0)).alias("active"))


#: Shares that calls are dealt into by their id; the calls of one are held, and dealt with, together.
CALL_SHARES = 512
_CALLS = pa.schema([("id", pa.string()), ("begun", pa.int64()), ("ended", pa.int64()), ("due", pa.int64())])


def _packed(calls: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, _CALLS) as writer:
        writer.write_table(calls)
    return out.getvalue().to_pybytes()


def _merged_calls(held: pa.Table, new: pa.Table, after_ms: int, watermark: int) -> pa.Table:
    """Calls (id, begun, ended, due, touched) once each: the earliest begin, the latest end, and until when they are waited for.

    What was touched by new events is waited for beyond the watermark at least.
    """
    rows = pa.concat_tables([held.append_column("touched", pa.array(np.zeros(len(held), dtype=np.int8))), new])
    calls = rows.group_by("id").aggregate([("begun", "min"), ("ended", "max"), ("due", "max"), ("touched", "max")])
    calls = calls.select(["id", "begun_min", "ended_max", "due_max", "touched_max"]).rename_columns([*_CALLS.names, "touched"])
    until = pc.max_element_wise(pc.add(pc.coalesce(calls["begun"], calls["ended"]), after_ms), watermark + 1)
    return calls.set_column(3, "due", pc.if_else(pc.equal(calls["touched"], 1), until, calls["due"]))


def calls_in_flight(events: DataFrame, after_s: int = ABANDONED_AFTER_S, delay: str = "0 seconds", shares: int = CALL_SHARES) -> DataFrame:
    """(id, begun, ended, outcome): tool calls from their begin and end events (id, phase, at); a call that isn't ended within ``after_s`` is
    ``abandoned``.

    Timers run in event time: they expire when the watermark passes begin + after_s. An end without a begin within that time is ``orphan``.

    Calls are dealt into ``shares`` by a hash of their id, for all calls of a share at once are as cheap as one alone. A share's state is its open
    calls, with when each is due, and its timer is the first of these. The number of shares doesn't change the result.
    """
    after_ms = after_s * 1000

    def process(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pa.ipc.open_stream(state.get[0]).read_all() if state.exists else _CALLS.empty_table()
        watermark = state.getCurrentWatermarkMs()
        parts = []
        for frame in [] if state.hasTimedOut else frames:
            ms, begins = frame["ms"].to_numpy(dtype="int64"), (frame["phase"] == "begin").to_numpy(dtype=bool)
            parts.append(
                pa.table(
                    [
                        pa.array(frame["id"], pa.string(), from_pandas=True), pa.array(ms, mask=~begins), pa.array(ms, mask=begins),
                        pa.nulls(len(frame), pa.int64()), pa.array(np.ones(len(frame), dtype=np.int8))
                    ],
                    names=[*_CALLS.names, "touched"]
                )
            )
        new = pa.concat_tables([_CALLS.append(pa.field("touched", pa.int8())).empty_table(), *parts])
        calls = _merged_calls(held, new, after_ms, watermark)
        whole = pc.and_(pc.is_valid(calls["begun"]), pc.is_valid(calls["ended"]))
        late = pc.less(calls["due"], watermark)
        over = pc.or_(whole, late)
        out, left = calls.filter(over), calls.filter(pc.invert(over)).select(_CALLS.names)
        if len(left):
            state.update((_packed(left),))
            state.setTimeoutTimestamp(max(pc.min(left["due"]).as_py(), watermark, 1))
        elif state.exists:
            state.remove()
        if len(out):
            took = pc.subtract(out["ended"], out["begun"])  # null unless there are both
            outcome = pc.if_else(
                pc.is_null(out["begun"]), "orphan", pc.if_else(pc.fill_null(pc.less_equal(took, after_ms), False), "done", "abandoned")
            )
            frame = out.select(["id", "begun", "ended"]).append_column("outcome", outcome)
            yield frame.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)

    share = F.pmod(F.xxhash64("id"), F.lit(shares)).cast("int")
    rows = events.withColumns({"ms": F.unix_millis("at"), "share": share}).withWatermark("at", delay)
    return rows.groupBy("share").applyInPandasWithState(
        process, "id string, begun long, ended long, outcome string", "calls binary", "append", GroupStateTimeout.EventTimeTimeout
    )


def last_touches(events: DataFrame, token: str, k: int = 5) -> DataFrame:
    """(token, touches): the last k (ts, ring, line) of each token, rising; an update per token and batch. The state holds k touches for each
    token."""
    kinds = dict(events.dtypes)
    touch = ["ts", "ring", "line"]

    def process(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in zip(*state.get)] if state.exists else []
        for frame in frames:
            held = sorted([*held, *frame[touch].itertuples(index=False, name=None)])[-k:]
        state.update(tuple(list(x) for x in zip(*held)))
        yield pd.DataFrame({token: [key[0]], "touches": [[dict(zip(touch, t)) for t in held]]})

    row = ", ".join(f"{c}: {kinds[c]}" for c in touch)
    return events.groupBy(token).applyInPandasWithState(
        process, f"{token} {kinds[token]}, touches array<struct<{row}>>", ", ".join(f"{c} array<{kinds[c]}>" for c in touch), "update",
        GroupStateTimeout.NoTimeout
    )


def touch_notes(touches: DataFrame, token: str, now: float, current: str, age_s: float) -> DataFrame:
    """(token, ring, ts): tokens whose last touch outside the current session is at least ``age_s`` old."""
    each = touches.select(token, F.explode("touches").alias("t")).filter(F.col("t.ring") != current)
    last = each.groupBy(token).agg(F.max_by("t", F.col("t.ts")).alias("t"))
    return last.filter(now - F.col("t.ts") >= age_s).select(token, F.col("t.ring").alias("ring"), F.col("t.ts").alias("ts"))


def composites(tokens: DataFrame, every: int = 5, k: int = 3) -> DataFrame:
    """(session, turn, composite): after every ``every``-th turn of a session, the ``k`` tokens it has dealt with most so far, as ``token=n`` and
    by name where equal.

    ``tokens`` is a stream of turns (session, seq, token), those of one micro-batch in any order. The state is a count for each distinct token of
    a session.
    """

    def process(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turn, names, counts = state.get if state.exists else (0, [], [])
        held = dict(zip(names, counts))
        rows = pd.concat(list(frames)).sort_values("seq")
        turns, made = [], []
        for token in rows["token"]:
            turn += 1
            if token is not None:
                held[token] = held.get(token, 0) + 1
            if turn % every == 0:
                best = sorted(held.items(), key=lambda x: (-x[1], x[0]))[:k]
                turns.append(turn)
                made.append(",".join(f"{t}={n}" for t, n in best))
        state.update((turn, list(held), list(held.values())))
        yield pd.DataFrame({"session": [key[0]] * len(turns), "turn": pd.array(turns, "int64"), "composite": made})

    held = "turn long, names array<string>, counts array<long>"
    return tokens.groupBy("session").applyInPandasWithState(
        process, "session string, turn long, composite string", held, "append", GroupStateTimeout.NoTimeout
    )
