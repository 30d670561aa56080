"""The concept graph as DataFrames, and its builders."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.names import canonicalize
from threadloom.model import BODY_STOPWORDS, stored_verb
from threadloom.staging import kept, spread, stage

BODY_TOKEN = r"[A-Za-z_][A-Za-z0-9_]{2,}"


@dataclass(frozen=True)
class Graph:
    """entities (id, partition_id, kind, name, canonical_name, noise, ...), links (linkage, concept_id, entity_id, weight) and, if known, evidence.

    The links are the single source of truth; concepts are entities of kind ``concept``. ids are global.
    """

    entities: DataFrame
    links: DataFrame
    evidence: DataFrame | None = None

    def scoped(self, partition_id: int) -> Graph:
        """Only what belongs to one partition: its entities and the links to them."""
        own = self.entities.filter(F.col("partition_id") == partition_id)
        return replace(self, entities=own, links=self.links.join(own.select(F.col("id").alias("entity_id")), "entity_id", "left_semi"))

    def concepts(self) -> DataFrame:
        return self.entities.filter("kind = 'concept'").select(
            F.col("id").alias("concept_id"), "name", "canonical_name", F.coalesce("noise", F.lit(0)).alias("noise")
        )


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _paths(sf_dir: str, *tables: str) -> list[str]:
    return [f"{sf_dir}/{t}.parquet" for t in tables]


def store_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The stored graph: entities once each, and one link for each bit of the fragments whose two ends exist.

    Both are built once and kept, links by verb and within it sorted by concept, so that a query reads the verbs and concepts that it asks for.
    """

    def entities() -> DataFrame:
        return read(spark, sf_dir, "entities").distinct()

    def links() -> DataFrame:
        bits = read(spark, sf_dir, "bitmap_fragments").select(
            stored_verb(F.col("linkage")).alias("linkage"), F.shiftright("bit", 32).alias("concept_id"),
            F.col("bit").bitwiseAND(F.lit(0xFFFFFFFF)).alias("entity_id")
        )
        ids = read(spark, sf_dir, "entities").select("id").distinct()
        return bits.distinct().join(ids.withColumnRenamed("id", "entity_id"), "entity_id", "left_semi").join(
            ids.withColumnRenamed("id", "concept_id"), "concept_id", "left_semi"
        )

    kept_entities = kept(spark, "entities", _paths(sf_dir, "entities"), entities)
    found = kept(spark, "links", _paths(sf_dir, "entities", "bitmap_fragments"), links, ["linkage"], ["concept_id", "entity_id"])
    return Graph(kept_entities, found.select("linkage", "concept_id", "entity_id", F.lit(None).cast("double").alias("weight")))


def body_terms(df: DataFrame, record: str, text: str, linkage: str = "mentions") -> DataFrame:
    """(linkage, concept, entity_id, weight): term counts of each text, without stop words."""
    terms = df.select(
        F.col(record).alias("entity_id"), F.explode(F.regexp_extract_all(text, F.lit(BODY_TOKEN), F.lit(0))).alias("t")
    ).select("entity_id", F.lower("t").alias("concept"))
    terms = terms.filter(~F.col("concept").isin(BODY_STOPWORDS))
    return terms.groupBy("concept", "entity_id").agg(F.count(F.lit(1)).cast("double").alias("weight")).select(
        F.lit(linkage).alias("linkage"), "concept", "entity_id", "weight"
    )


def lead_text(text, lines: int = 3):
    """The first lines of a text that aren't blank."""
    return F.array_join(F.slice(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), 1, lines), "\n")


def document_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(linkage, concept, entity_id, weight) of the documents: mentions by term count, lead by presence, tagged by language and source."""
    docs = spread(read(spark, sf_dir, "documents").select(F.col("doc_id"), "text", "lang", "source"))
    mentions = body_terms(docs, "doc_id", "text")
    lead = body_terms(docs.select("doc_id", lead_text(F.col("text")).alias("text")), "doc_id", "text", "lead").withColumn("weight", F.lit(1.0))
    tags = docs.select(
        "doc_id", F.explode(F.array_compact(F.array(F.concat(F.lit("lang/"), "lang"), F.concat(F.lit("source/"), "source")))).alias("concept")
    )
    return mentions.unionByName(lead).unionByName(
        tags.select(F.lit("tagged").alias("linkage"), "concept", F.col("doc_id").alias("entity_id"), F.lit(1.0).alias("weight"))
    )


def document_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of the documents (linkage, concept_id, entity_id, weight, dl), built once and kept by verb and concept; dl is the entity's
    length, the sum of its mentions' weights."""

    def build() -> DataFrame:
        links = stage(document_links(spark, sf_dir), "document-links")
        length = links.filter("linkage = 'mentions'").groupBy("entity_id").agg(F.sum("weight").alias("dl"))
        return links.join(length, "entity_id", "left").select("linkage", F.col("concept").alias("concept_id"), "entity_id", "weight", "dl")

    return kept(spark, "document-index", _paths(sf_dir, "documents"), build, ["linkage"], ["concept_id", "entity_id"])


_figures: dict[str, tuple[int, float]] = {}


def document_figures(spark: SparkSession, sf_dir: str) -> tuple[int, float]:
    """The number of documents in the index and their mean length, worked out once for each index."""
    index = document_index(spark, sf_dir)
    place = index.inputFiles()[0].rsplit("/", 2)[0] if index.inputFiles() else ""
    if place not in _figures:
        length = index.filter("linkage = 'mentions'").groupBy("entity_id").agg(F.max("dl").alias("dl"))
        n, mean = length.agg(F.count(F.lit(1)), F.avg("dl")).first()
        _figures[place] = (n, mean or 0.0)
    return _figures[place]


def with_concept_ids(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links with a concept id (a hash of the name, 60 bits, above all table ids) and the concepts (concept_id, name, canonical_name)."""
    identified = links.withColumn("concept_id", F.shiftrightunsigned(F.xxhash64("concept"), 4) + F.lit(1 << 33))
    concepts = identified.select("concept_id", F.col("concept").alias("name")).distinct().withColumn("canonical_name", canonicalize(F.col("name")))
    return identified.select("linkage", "concept_id", "entity_id", "weight"), concepts
