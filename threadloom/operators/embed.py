"""Texts of entities for embedding, and embedding in batches with any encoder."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: encoders see this much of a text.
MOST_CHARS = 4096
Encoder = Callable[[Sequence[str]], np.ndarray]


def entity_text(kind: Column, name: Column, canonical: Column, tldr: Column, content: Column, mtype: Column, tags: Column) -> Column:
    """What stands for an entity: a memory's ``[type] body`` and tags (its name without a body), a concept's name and other spelling with its
    summary, else name and summary."""
    empty = F.lit("")
    memory = F.when(
        content.isNotNull(), F.trim(F.concat(F.lit("["), F.coalesce(mtype, empty), F.lit("] "), content, F.lit("\n"), F.coalesce(tags, empty)))
    ).otherwise(F.coalesce(name, empty))
    head = F.concat(
        F.coalesce(name, empty),
        F.when(canonical.isNotNull() & (canonical != "") & ~canonical.eqNullSafe(name), F.concat(F.lit(" "), canonical)).otherwise(empty)
    )
    body = F.trim(F.coalesce(tldr, empty))
    concept = F.when(body != "", F.concat(head, F.lit("\n"), body)).otherwise(head)
    plain = F.trim(F.concat_ws("\n", F.nullif(name, empty), F.nullif(tldr, empty)))
    return F.when(kind == "memory", memory).when(kind == "concept", concept).when(kind.isin("code", "doc"), plain).otherwise(empty)


def entity_texts(entities: DataFrame, memories: DataFrame) -> DataFrame:
    """(id, kind, text) of the entities that have any text."""
    m = memories.select(F.col("entity_id").alias("id"), "content", "mtype", "tags").dropDuplicates(["id"])
    rows = entities.join(m, "id", "left")
    text = entity_text(*[F.col(c) for c in ("kind", "name", "canonical_name", "tldr", "content", "mtype", "tags")])
    return rows.select("id", "kind", text.alias("text")).filter("text != ''")


def hashed_encoder(dims: int = 256) -> Encoder:
    """An encoder without a model: signed counts of words and letter triples at hashed places. Similar spellings and shared words come close."""

    def encode(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims), dtype=np.float32)
        for i, text in enumerate(texts):
            words = text.lower().split()
            for token in [*words, *(f"^{w}$"[k : k + 3] for w in words for k in range(len(w)))]:
                h = xxhash.xxh64_intdigest(token)
                out[i, h % dims] += 1.0 if h >> 63 else -1.0
        return out

    return encode


def embed(texts: DataFrame, make_encoder: Callable[[], Encoder] = hashed_encoder, most_chars: int = MOST_CHARS) -> DataFrame:
    """(id, vector) of (id, text), of unit length; empty texts and those whose vector is nothing are left out.

    ``make_encoder`` is called once for each task, so a model is loaded where it is used. Texts are cut at ``most_chars`` characters.
    """
    rows = texts.filter(F.col("text") != "").select("id", F.substring("text", 1, most_chars).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make_encoder()
        for frame in frames:
            made = np.asarray(encode(frame["text"].tolist()), dtype=np.float64).reshape(len(frame), -1)
            norm = np.linalg.norm(made, axis=1)
            some = norm > 0
            unit = (made[some] / norm[some, None]).astype(np.float32)
            yield pd.DataFrame({"id": frame["id"][some].to_numpy(), "vector": pd.Series(list(unit), dtype=object)})

    return rows.mapInPandas(run, T.StructType([rows.schema["id"], T.StructField("vector", T.ArrayType(T.FloatType()))]))
