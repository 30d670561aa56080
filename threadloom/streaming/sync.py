"""Incremental sync: files that change, the queue of paths, and the queue of searches to learn from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.sources import files as tree
from threadloom.streaming.runner import each_batch


def plan_sync(now: DataFrame, tracked: DataFrame) -> DataFrame:
    """(path, action): ``extract`` for new and changed files, ``purge`` for tracked ones that are gone."""
    return tree.changed(now, tracked).select("path", F.lit("extract").alias("action")).unionByName(
        tree.deleted(now, tracked).select("path", F.lit("purge").alias("action"))
    )


def apply_sync(tables: dict[str, DataFrame], plan: DataFrame, fresh: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables (with a path column) without the rows of all planned paths, and with the freshly extracted ones: one set-based change."""
    gone = plan.select("path").distinct()
    return {
        name: df.join(gone, "path", "left_anti").unionByName(fresh[name]) if name in fresh else df.join(gone, "path", "left_anti") for name,
        df in tables.items()
    }


def drain(queue: DataFrame, key: str = "path", order: str = "seq") -> DataFrame:
    """A queue's entries once each, in order of their first arrival."""
    return queue.groupBy(key).agg(F.min(order).alias(order)).orderBy(order)


def run_queue(spark: SparkSession, folder: str, schema: str, work: Callable[[DataFrame, int], None], files_per_batch: int = 100) -> None:
    """Work through the JSON-lines files of a folder in micro-batches, at least once each; what was done is kept in the checkpoint."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)
    each_batch(stream, work, "queue")


#: Searches that one drain takes; older ones are reported as overflow, by number.
MOST_QUEUED = 10_000


def batch_of(queue: DataFrame, most: int = MOST_QUEUED) -> tuple[DataFrame, DataFrame]:
    """What a drained queue of searches holds, (pattern, first, file, line), each hit once, in the order of the patterns' first search; and
    (lines, malformed, overflow).

    ``queue`` has (seq, value), lines of JSON ``{pattern, hits: [{file, line}]}``. Lines that aren't, and hits without a place, are malformed. Of
    more than ``most`` lines the newest are taken.
    """
    parsed = F.from_json("value", "pattern string, hits array<struct<file: string, line: string>>")
    rows = queue.filter(F.trim("value") != "").select("seq", parsed.alias("q")).select(
        "seq", F.col("q.pattern").alias("pattern"), F.col("q.hits").alias("hits")
    )
    good = (F.col("pattern") != "") & F.col("hits").isNotNull()
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    newest = rows.filter("good").orderBy(F.desc("seq")).limit(most)
    hits = newest.select("seq", "pattern", F.explode("hits").alias("h")).select(
        "seq", "pattern", "h.file", F.col("h.line").try_cast("int").alias("line")
    )
    placed = hits.filter("file IS NOT NULL AND line IS NOT NULL")
    first = newest.groupBy("pattern").agg(F.min("seq").alias("first"))
    entries = placed.select("pattern", "file", "line").distinct().join(first, "pattern").select("pattern", "first", "file", "line")
    lines = rows.agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.when(F.col("good"), 0).otherwise(1)).alias("bad"), F.sum(F.col("good").cast("long")).alias("ok")
    )
    lost = hits.agg(F.count(F.when(F.col("file").isNull() | F.col("line").isNull(), 1)).alias("no_place"))
    report = lines.crossJoin(lost).select(
        "lines", (F.coalesce("bad", F.lit(0)) + F.col("no_place")).alias("malformed"),
        F.greatest(F.coalesce("ok", F.lit(0)) - most, F.lit(0)).alias("overflow")
    )  # one row each
    return entries, report


def requeued(entries: DataFrame, done: DataFrame, from_seq: int) -> DataFrame:
    """(seq, value): entries whose pattern isn't among those done (pattern), as lines at the tail of a queue."""
    left = entries.join(done.select("pattern").distinct(), "pattern", "left_anti")
    lines = left.groupBy("pattern", "first").agg(
        F.to_json(F.struct("pattern", F.array_sort(F.collect_list(F.struct("file", "line"))).alias("hits"))).alias("value")
    )
    return lines.select((F.col("first") + from_seq).alias("seq"), "value")


def learned(hits: DataFrame) -> DataFrame:
    """(concept, path, line): search hits (pattern, path, line) as mentions of ``query/<pattern>`` with their evidence."""
    return hits.filter("pattern != '' AND path IS NOT NULL").select(
        F.concat(F.lit("query/"), F.lower(F.trim("pattern"))).alias("concept"), "path", "line"
    ).distinct()


def due(jobs: DataFrame, now: float) -> DataFrame:
    """Jobs (name, every_s, last_run) whose interval is over; a job that never ran is due."""
    return jobs.filter(F.col("last_run").isNull() | (F.lit(now) - F.col("last_run") >= F.col("every_s")))
