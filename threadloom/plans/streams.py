"""Streams over the event table, run to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.graph import read
from threadloom.plans.store_analytics import BUS, messages
from threadloom.plans.store_changes import ORACLE as CHANGES
from threadloom.plans.store_changes import _log
from threadloom.streaming import focus, runner, state, windows


def _events(spark, sf_dir):
    return read(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))


def focus_events(spark, sf_dir):
    """Events as references of a session: signup is input, the rest are tools; the key in props and the type are what is referred to."""
    ev = read(spark, sf_dir, "events")
    return ev.select(
        F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "signup", "input").otherwise("tool").alias("kind"),
        F.array(F.concat(F.lit("k"), F.get_json_object("props", "$.k")), F.col("event_type")).alias("refs"),
    )


def focus_graph(spark, sf_dir):
    return focus.focus_graphs(focus_events(spark, sf_dir), budget=40)


def focus_graph_stream(spark, sf_dir):
    """The same graphs, built by the stream in several batches."""
    stream = runner.replayed(spark, focus_events(spark, sf_dir), files_per_batch=2, order="seq")
    return runner.latest_of_updates(focus.focus_stream(stream, budget=40), ["session", "name"], "focus").select(focus_graph(spark, sf_dir).columns)


def stream_tumbling(spark, sf_dir):
    """Events of each type in windows of a day, by a stream with late data kept for a year."""
    stream = runner.replayed(spark, _events(spark, sf_dir).select("at", "event_type", "value"), files_per_batch=1)
    rows = windows.windowed_counts(stream, "at", "event_type", "1 day", delay="365 days")
    out = runner.latest_of_updates(rows, ["start", "event_type"], "tumbling")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


def stream_sliding(spark, sf_dir):
    stream = runner.replayed(spark, _events(spark, sf_dir).select("at", "event_type", "value"))
    rows = windows.windowed_counts(stream, "at", "event_type", "2 days", "1 day", delay="365 days")
    return runner.latest_of_updates(rows, ["start", "event_type"], "sliding").select(
        F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n"
    )


def stream_debounce(spark, sf_dir):
    """Bursts of changes of each user with an hour of quiet between them."""
    stream = runner.replayed(spark, _events(spark, sf_dir).select("at", "user_id", F.col("event_type").alias("path")))
    rows = windows.debounced(stream, "at", "path", "1 hour", "365 days", root="user_id")
    return runner.latest_of_updates(rows, ["root", "start", "end"], "bursts", mode="complete").select(
        F.col("root").alias("user_id"), F.col("start").cast("timestamp_ntz").alias("start"), F.array_join("paths", ",").alias("paths"), "n"
    )


def stream_replay(spark, sf_dir):
    """The mutation log as a stream, in three batches: the entities alive at its end."""
    stream = runner.replayed(spark, _log(spark, sf_dir), files_per_batch=1, files=3)
    return runner.latest_of_updates(state.live_entities(stream), ["kind", "name"], "replay").filter("alive").drop("alive")


def stream_channels(spark, sf_dir):
    stream = runner.replayed(spark, messages(spark, sf_dir).select("seq", "channel", "status"), files_per_batch=2)
    return runner.latest_of_updates(state.channel_heads(stream), ["channel"], "heads")


def stream_in_flight(spark, sf_dir):
    """Signups begin a call that the user's next purchase of the same key ends; others are abandoned after a day."""
    ev = _events(spark, sf_dir).filter("event_type IN ('signup', 'purchase')")
    rows = ev.select(
        F.concat_ws("-", F.col("user_id"), F.get_json_object("props", "$.k")).alias("id"),
        F.when(F.col("event_type") == "signup", "begin").otherwise("end").alias("phase"), "at"
    )
    end = spark.range(1).select(F.lit("end-of-input").alias("id"), F.lit("begin").alias("phase"), F.lit("2199-01-01").cast("timestamp").alias("at"))
    stream = runner.replayed(spark, rows.unionByName(end))
    return runner.to_table(state.calls_in_flight(stream, after_s=86_400), "calls").filter("id != 'end-of-input'")


def stream_dedup(spark, sf_dir):
    """Events delivered twice, once each."""
    ev = _events(spark, sf_dir).select("event_id", "event_type", "at")
    stream = runner.replayed(spark, ev.unionByName(ev.filter("event_id % 3 = 0")))
    return runner.to_table(
        windows.deduplicated(stream, ["event_id"], "at", "365 days"), "once"
    ).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        focus_graph, focus_graph_stream, stream_tumbling, stream_sliding, stream_debounce, stream_replay, stream_channels, stream_in_flight,
        stream_dedup
    )
}

ORACLE = {
    "stream_in_flight": "WITH e AS (SELECT user_id || '-' || json_extract_string(props, '$.k') AS id, min(epoch_us(CAST(ts AS TIMESTAMP)) // 1000) FILTER (WHERE event_type = 'signup') AS begun, max(epoch_us(CAST(ts AS TIMESTAMP)) // 1000) FILTER (WHERE event_type = 'purchase') AS ended "
    "FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY 1) SELECT id, begun, ended, CASE WHEN begun IS NULL THEN 'orphan' WHEN ended IS NULL OR ended - begun > 86400000 THEN 'abandoned' ELSE 'done' END AS outcome FROM e",
    "stream_tumbling": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
    "stream_sliding": "SELECT start, event_type, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 2 DAY, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 2 DAY, ts, TIMESTAMP '1970-01-02')]) AS start, event_type FROM events) GROUP BY 1, 2",
    "stream_debounce": "WITH o AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events), s AS (SELECT *, sum(CASE WHEN b IS NULL OR ts >= b + INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM o) SELECT user_id, min(ts) AS start, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS paths, count(*) AS n FROM s GROUP BY user_id, g",
    "stream_replay": CHANGES["log_replay_lww"],
    "stream_channels": BUS + " SELECT channel, max(seq) AS last_seq, count(*) FILTER (WHERE status = 'active') AS active FROM msg GROUP BY 1",
    "stream_dedup": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
}
