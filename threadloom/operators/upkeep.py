"""Upkeep of the store: batched and bulk writes, memories added and forgotten, partitions renamed, vectors dropped, links repaired, snapshots."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.names import glob_pattern
from threadloom.graph import Graph
from threadloom.operators import mutate
from threadloom.staging import new_path


class DeferredLinks:
    """Links gathered from many writers and merged in one pass: ``with DeferredLinks(links) as d: d.add(batch)``, then ``d.links``. Nothing is
    merged if the block fails."""

    def __init__(self, links: DataFrame, policy: str = "first") -> None:
        self.links, self.policy = links, policy
        self._batches: list[DataFrame] = []

    def add(self, batch: DataFrame) -> None:
        """A batch (linkage, concept_id, entity_id, weight, seq); seq orders the links within it, batches count in the order of adding."""
        self._batches.append(batch.withColumn("_b", F.lit(len(self._batches))))

    def __enter__(self) -> DeferredLinks:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None and self._batches:
            whole = self._batches[0]
            for b in self._batches[1:]:
                whole = whole.unionByName(b)
            # A batch's place is the upper part of the order; its own seq the lower.
            ordered = whole.withColumn("seq", F.shiftleft(F.col("_b").cast("long"), 62 - 16) + F.col("seq")).drop("_b")
            self.links = mutate.merge_links(self.links, ordered, self.policy)
        self._batches = []


def bulk_write(spark: SparkSession, batches: Sequence[pa.RecordBatch], path: str, partition_by: Sequence[str] = ()) -> int:
    """Append Arrow batches of a client to a table in one write; the number of rows."""
    table = pa.Table.from_batches(batches)
    writer = spark.createDataFrame(table).write.mode("append").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return table.num_rows


def add_memories(graph: Graph, memories: DataFrame, batch: DataFrame) -> tuple[Graph, DataFrame]:
    """The store with memories (partition_id, name, content, mtype, tags, metadata, now, seq) added; of an existing name, what is given replaces
    what was there."""
    named = batch.select(
        "partition_id", F.lit("memory").alias("kind"), "name", *[F.lit(None).cast("string").alias(c) for c in ("path", "tldr", "meta")],
        F.lit(0).alias("protected"), F.lit(None).cast("string").alias("canonical_name"), "now", "seq"
    )
    entities = mutate.upsert_entities(graph.entities, named)
    ids = entities.filter("kind = 'memory'").groupBy("partition_id", "name").agg(F.min("id").alias("entity_id"))
    last = batch.groupBy("partition_id", "name").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in ("content", "mtype", "tags", "metadata")],
        F.max("now").alias("now")
    )
    new = ids.join(last, ["partition_id", "name"]).select(
        "entity_id", *[F.col(c).alias(f"n_{c}") for c in ("content", "mtype", "tags", "metadata", "now")]
    )
    both = memories.withColumn("_old", F.lit(1)).join(new, "entity_id", "full")
    cols = [F.coalesce(f"n_{c}", c).alias(c) for c in ("content", "mtype", "tags", "metadata")]
    return replace(graph, entities=entities), both.select(
        "entity_id", *cols, F.coalesce("created_at", "n_now").alias("created_at"), F.coalesce("n_now", "updated_at").alias("updated_at")
    )


def forgettable(
    graph: Graph, memories: DataFrame, name: str = "*", mtype: str = "*", tag: str | None = None, older_than: float | None = None
) -> DataFrame:
    """(id, name, mtype): memories that globs of name and type, a tag and an age find. Protected ones aren't among them."""
    m = graph.entities.filter("kind = 'memory' AND coalesce(protected, 0) = 0").select("id", "name").join(
        memories.withColumnRenamed("entity_id", "id"), "id"
    )
    m = m.filter(F.col("name").rlike(glob_pattern(name)) & F.coalesce(F.col("mtype"), F.lit("")).rlike(glob_pattern(mtype)))
    if tag is not None:
        m = m.filter(F.coalesce(F.array_contains(F.from_json("tags", "array<string>"), tag), F.lit(False)))
    if older_than is not None:
        m = m.filter(F.col("updated_at") < older_than)
    return m.select("id", "name", "mtype")


def bulk_forget(graph: Graph, memories: DataFrame, **selector) -> tuple[Graph, DataFrame]:
    return mutate.purge(graph, forgettable(graph, memories, **selector), memories)


def rename_partition(partitions: DataFrame, old: str, new: str) -> DataFrame:
    """Partitions with one renamed; refused if the old name isn't there or the new one is."""
    names = {r["name"] for r in partitions.filter(F.col("name").isin(old, new)).select("name").limit(2).collect()}
    if old not in names or new in names:
        raise ValueError(f"no partition {old}" if old not in names else f"there is a partition {new} already")
    return partitions.withColumn("name", F.when(F.col("name") == old, new).otherwise(F.col("name")))


def drop_vectors(vectors: DataFrame, entities: DataFrame, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Vectors without those of ``ids`` (id), all if none are given, and entities that no longer claim to have one."""
    gone = (vectors if ids is None else ids).select("id").distinct()
    marked = entities.join(gone.withColumn("_g", F.lit(1)), "id", "left")
    marked = marked.withColumn("vectors_updated_at", F.when(F.col("_g").isNull(), F.col("vectors_updated_at"))).select(*entities.columns)
    return vectors.join(gone, "id", "left_anti"), marked


def repair(bits: DataFrame, entities: DataFrame) -> DataFrame:
    """Distinct links whose two ends exist, from bits (linkage, concept_id, entity_id) of any spelling: what an index is built from again."""
    ids = entities.select("id").distinct()
    rows = bits.select(F.translate(F.lower("linkage"), "_", "-").alias("linkage"), "concept_id", "entity_id").distinct()
    return rows.join(ids.withColumnRenamed("id", "entity_id"), "entity_id", "left_semi").join(
        ids.withColumnRenamed("id", "concept_id"), "concept_id", "left_semi"
    ).select(*mutate.LINK_KEY)


def snapshot(tables: dict[str, DataFrame], folder: str, version: int, rows_per_file: int = 5_000_000) -> dict[str, DataFrame]:
    """Tables written below ``folder/v<version>``, compacted into files of up to rows_per_file rows and sorted for pruning, as read back. Versions
    aren't overwritten."""
    out = {}
    for name, df in tables.items():
        keys = [k for k in ("linkage", "concept_id", "partition_id", "kind", "id", "entity_id") if k in df.columns][:2]
        path = f"{folder}/v{version}/{name}.parquet"
        ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df
        ranged.write.mode("error").option("maxRecordsPerFile", rows_per_file).option("compression", "zstd").parquet(path)
        out[name] = df.sparkSession.read.schema(df.schema).parquet(path)
    return out


def latest_snapshot(spark: SparkSession, folder: str, name: str, versions: Sequence[int]) -> DataFrame:
    return spark.read.parquet(f"{folder}/v{max(versions)}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder for snapshots in the shared folder."""
    return new_path(spark, "snapshots")
