"""Reports over logs and sessions: derivations, command lines, context cost, usage, session lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.operators.analytics import anchored_windows, nearest_rank

PROMPT_COMMANDS = ("scan-prompt",)


def derivation_state(stamps: DataFrame, current: DataFrame) -> DataFrame:
    """(pass_name, state): ``fresh``, ``stale`` (another version or code), ``never`` or ``unknown`` of each pass, by its latest stamp (pass_name,
    version, code_hash, derived_at)."""
    last = stamps.withColumn("_n", F.row_number().over(W.partitionBy("pass_name").orderBy(F.desc("derived_at")))).filter("_n = 1").select(
        "pass_name", F.col("version").alias("v"), F.col("code_hash").alias("h"), F.lit(1).alias("seen")
    )
    rows = current.select("pass_name", "version", "code_hash", F.lit(1).alias("known")).join(last, "pass_name", "full")
    same = F.col("version").eqNullSafe(F.col("v")) & F.col("code_hash").eqNullSafe(F.col("h"))
    return rows.select(
        "pass_name",
        F.when(F.col("known").isNull(), "unknown").when(F.col("seen").isNull(), "never").when(same, "fresh").otherwise("stale").alias("state")
    )


def command_summary(log: DataFrame) -> DataFrame:
    """(command, n, errors, p50, p95): calls of the first word of argv (array), starts left out; an exit code other than 0 is an error."""
    rows = log.filter("phase IS NULL OR phase != 'start'").withColumn("command", F.get(F.col("argv"), F.lit(0)))
    counts = rows.groupBy("command").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("exit_code") != 0, 1).otherwise(0)).alias("errors"))
    return counts.join(nearest_rank(rows, ["command"], "latency_ms", {"p50": 0.5, "p95": 0.95}), "command", "left")


def context_cost(log: DataFrame, window_s: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """Costs by command, (command, n, unknown, total, mean, p50, p95, most), and by prompt, (session, window_start, total).

    ``log`` has (session, command, t, out_bytes). Rows without out_bytes are unknown, not 0. A prompt's window opens at a session's first call and
    holds those up to window_s
    later; windows without a prompt command don't count.
    """
    known = log.filter("out_bytes IS NOT NULL")
    counts = log.groupBy("command").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("out_bytes").isNull(), 1).otherwise(0)).alias("unknown"), F.sum("out_bytes").alias("total"),
        F.floor(F.avg("out_bytes")).alias("mean"), F.max("out_bytes").alias("most")
    )
    ranks = nearest_rank(known, ["command"], "out_bytes", {"p50": 0.5, "p95": 0.95})
    windows = anchored_windows(log.select("session", "command", "t", "out_bytes"), "session", "t", window_s)
    prompts = windows.groupBy("session", "window_start").agg(
        F.sum("out_bytes").alias("total"), F.max(F.col("command").isin(*PROMPT_COMMANDS).cast("int")).alias("p")
    ).filter("p = 1").drop("p")
    return counts.join(ranks, "command", "left"), prompts


def usage(log: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """(dimension, key, n, p50, p95) of calls in [since, until) by kind, source, invocation and outcome."""
    rows = log
    if since:
        rows = rows.filter(F.col("ts") >= since)
    if until:
        rows = rows.filter(F.col("ts") < until)
    each = rows.select(
        "latency_ms",
        F.explode(
            F.map_from_arrays(
                F.array(*[F.lit(d) for d in ("kind", "source", "invocation", "outcome")]), F.array("kind", "source", "invocation", "outcome")
            )
        ).alias("dimension", "key")
    ).filter("key IS NOT NULL")
    counts = each.groupBy("dimension", "key").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(nearest_rank(each, ["dimension", "key"], "latency_ms", {"p50": 0.5, "p95": 0.95}), ["dimension", "key"], "left")


def list_sessions(cards: DataFrame, offset: int = 0, limit: int = 20) -> DataFrame:
    """Sessions by their end, newest first."""
    return cards.orderBy(F.desc_nulls_last("last_ts"), "session").offset(offset).limit(limit)


def recall_sessions(
    cards: DataFrame, text: str, project: str | None = None, branch: str | None = None, commit: str | None = None, touched: str | None = None,
    since: str | None = None, k: int = 10
) -> DataFrame:
    """Sessions whose title or prompts hold a text, within the filters, newest first."""
    hay = F.lower(F.concat_ws("\n", "title", F.array_join("prompts", "\n")))
    rows = cards.filter(hay.contains(text.lower()))
    for want, test in (
        (project, lambda x: F.col("cwd").contains(x)), (branch, lambda x: F.col("branch") == x),
        (commit, lambda x: F.exists("commits", lambda c: c.contains(x))), (touched, lambda x: F.exists("files", lambda f: f.contains(x))),
        (since, lambda x: F.col("last_ts") >= x)
    ):
        if want is not None:
            rows = rows.filter(test(want))
    return list_sessions(rows, 0, k)


def show_session(cards: DataFrame, ref: str) -> DataFrame:
    """The session of a name or of a prefix of at least eight characters; several are an error."""
    rows = cards.filter((F.col("session") == ref) | (F.col("session").startswith(ref) if len(ref) >= 8 else F.lit(False)))
    if rows.limit(2).count() > 1:
        raise ValueError(f"several sessions begin with {ref}")
    return rows


def upsert_vectors(old: DataFrame, new: DataFrame) -> DataFrame:
    """Vectors (id, vector, updated_at) with new ones in place of old ones of the same id; of one id, the latest."""
    rows = old.withColumn("_s", F.lit(0)).unionByName(new.withColumn("_s", F.lit(1)))
    return rows.withColumn(
        "_n", F.row_number().over(W.partitionBy("id").orderBy(F.desc("_s"), F.desc("updated_at")))
    ).filter("_n = 1").drop("_n", "_s")
