"""Foreign stores: catalogs in a relational database, and migration of their tables to Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("partitions", "entities", "concepts", "memory_content", "linkage_types", "entity_links", "evidence", "tracked_files", "saved_queries")


def jdbc_table(
    spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16, **options: str
) -> DataFrame:
    """A table over JDBC, read in parallel by ranges of a numeric key where bounds are given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
    return reader.load()


def migrate(tables: dict[str, DataFrame], target: str, partition_by: dict[str, list[str]] | None = None) -> None:
    """Write tables below a folder as Parquet, entities and links partitioned for pruning."""
    layout = {"entities": ["partition_id"], "entity_links": ["linkage"]} | (partition_by or {})
    for name, df in tables.items():
        keys = [k for k in layout.get(name, []) if k in df.columns]
        writer = (df.repartition(*keys) if keys else df).write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(*keys) if keys else writer).parquet(f"{target}/{name}.parquet")
