"""Session transcripts and logs as JSON lines: sessions, turns, tool calls, mutation events, telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TRANSCRIPT = (
    "type string, message struct<role:string, content:string, model:string>, timestamp string, cwd string, gitBranch string, aiTitle string, sessionId string, isSidechain boolean, uuid string, parentUuid string"
)
LOG_EVENT = "ts double, op string, partition string, kind string, name string, linkage string, c_kind string, c string, e_kind string, e string, weight double, path string, mtime double, value string"
TELEMETRY = "ts string, kind string, source string, invocation string, body string, cardinality int, latency_ms int, outcome string, answered_by string, error string"
COMMIT = r"\b[0-9a-f]{7,12}\b"
_BLOCKS = "array<struct<type:string, text:string, name:string, id:string, tool_use_id:string, is_error:boolean, input:string>>"


def json_lines(spark: SparkSession, path: str, schema: str, since: str | None = None) -> DataFrame:
    """Lines of JSON by a schema, with ``_bad`` for lines that aren't; ``since`` keeps rows whose ts text isn't before it."""
    rows = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.filter(F.col("ts") >= since) if since else rows


def transcript(spark: SparkSession, path: str) -> DataFrame:
    """Transcript lines with ``session`` (the file's name, where a line names none) and ``line_no``."""
    rows = spark.read.schema(TRANSCRIPT).json(path).withColumn("_file", F.input_file_name())
    name = F.regexp_extract("_file", r"([^/]+?)(\.[a-z]+)?$", 1)
    return rows.withColumn("session", F.coalesce("sessionId", name)).withColumn("line_no", F.monotonically_increasing_id()).drop("_file")


def blocks(content: Column) -> Column:
    """The content of a message as blocks; plain text is one text block."""
    return F.when(content.startswith("["), F.from_json(content, _BLOCKS)).otherwise(
        F.array(
            F.struct(
                F.lit("text").alias("type"), content.alias("text"), *[F.lit(None).cast("string").alias(c) for c in ("name", "id", "tool_use_id")],
                F.lit(None).cast("boolean").alias("is_error"), F.lit(None).cast("string").alias("input")
            )
        )
    )


def is_prompt(rows: DataFrame) -> Column:
    """A line that a person typed: from the user, not the result of a tool, not from a side chain."""
    return (F.col("type") == "user") & ~F.coalesce("isSidechain", F.lit(False)) & ~F.coalesce(
        F.col("message.content").contains('"tool_result"'), F.lit(False)
    )


def session_cards(rows: DataFrame) -> DataFrame:
    """(session, title, cwd, branch, first_ts, last_ts, prompts, turns, tools, files, commits, models, sha): one row per session."""
    prompt = is_prompt(rows)
    b = rows.withColumn("b", F.when(F.col("message.content").isNotNull(), blocks(F.col("message.content"))))
    tools = F.transform(F.filter("b", lambda x: x["type"] == "tool_use"), lambda x: x["name"])
    files = F.filter(
        F.transform(F.filter("b", lambda x: x["type"] == "tool_use"), lambda x: F.get_json_object(x["input"], "$.file_path")), lambda x: x.isNotNull()
    )
    return (
        b.groupBy("session")
        .agg(
            F.max_by("aiTitle", F.when(F.col("aiTitle").isNotNull(), F.col("line_no"))).alias("title"),
            F.max_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("line_no"))).alias("cwd"),
            F.max_by("gitBranch", F.when(F.col("gitBranch").isNotNull(), F.col("line_no"))).alias("branch"), F.min("timestamp").alias("first_ts"),
            F.max("timestamp").alias("last_ts"),
            F.array_sort(F.collect_list(F.when(prompt, F.struct("line_no", F.col("message.content").alias("text"))))).alias("p"),
            F.flatten(F.collect_list(tools)).alias("tools"), F.array_distinct(F.flatten(F.collect_list(files))).alias("files"),
            F.array_sort(
                F.array_distinct(F.flatten(F.collect_list(F.regexp_extract_all(F.coalesce("message.content", F.lit("")), F.lit(COMMIT), F.lit(0)))))
            ).alias("commits"),
            F.array_sort(F.collect_set("message.model")).alias("models"),
        )
        .withColumn(
            "prompts",
            F.transform(F.filter("p", lambda x, i: (i == 0) | ~x["text"].eqNullSafe(F.get(F.col("p"), i - 1)["text"])), lambda x: x["text"])
        )
        .withColumn(
            "tool_counts",
            F.map_from_entries(F.transform(F.array_distinct("tools"), lambda t: F.struct(t, F.size(F.filter("tools", lambda u: u == t)))))
        )
        .select(
            "session", "title", "cwd", "branch", "first_ts", "last_ts", "prompts", F.size("p").alias("turns"), "tool_counts", "files", "commits",
            "models", F.sha2(F.array_join("prompts", "\n"), 256).alias("sha")
        )
    )


def actions(rows: DataFrame) -> DataFrame:
    """(session, turn, line_no, tool, id, error, result_line): tool calls with the turn that they belong to, and what came back."""
    w = W.partitionBy("session").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    turned = rows.withColumn("turn", F.sum(F.when(is_prompt(rows), 1).otherwise(0)).over(w)).filter(F.col("message.content").startswith("["))
    each = turned.select("session", "turn", "line_no", F.explode(blocks(F.col("message.content"))).alias("b"))
    calls = each.filter("b.type = 'tool_use'").select("session", "turn", "line_no", F.col("b.name").alias("tool"), F.col("b.id").alias("id"))
    back = each.filter("b.type = 'tool_result'").select(
        "session", F.col("b.tool_use_id").alias("id"), F.coalesce("b.is_error", F.lit(False)).alias("error"), F.col("line_no").alias("result_line")
    )
    return calls.join(back, ["session", "id"], "left")


def tree_stats(rows: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """(session, turns, actions, errors, tool_counts) of each session, from its transcript and its tool calls, nested ones included where
    ``calls`` is grafted."""
    calls = actions(rows) if calls is None else calls
    owner = F.col("root") if "root" in calls.columns else F.col("session")
    per_tool = calls.groupBy(owner.alias("session"), "tool").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("error", F.lit(False)).cast("int")).alias("e")
    )
    acted = per_tool.groupBy("session").agg(
        F.sum("n").alias("actions"), F.sum("e").alias("errors"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", "n")))).alias("tool_counts")
    )
    turns = rows.groupBy("session").agg(F.sum(is_prompt(rows).cast("int")).alias("turns"))
    return turns.join(acted, "session", "left").select(
        "session", F.coalesce("turns", F.lit(0)).alias("turns"), F.coalesce("actions", F.lit(0)).alias("actions"),
        F.coalesce("errors", F.lit(0)).alias("errors"), "tool_counts"
    )


def grafted(calls: DataFrame, links: DataFrame) -> DataFrame:
    """Calls with the parent call of the session that they run in: ``links`` is (session, parent_session, parent_id) of sub-agents."""
    return calls.join(links, "session", "left").withColumn("root", F.coalesce("parent_session", "session"))
