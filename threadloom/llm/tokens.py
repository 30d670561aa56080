"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vocabulary file of byte-level BPE ranks on the driver; a parameter of every operator that counts tokens, and of a session by this setting.
VOCABULARY, SETTING = "/opt/tokenizers/byte_bpe_50k.tiktoken", "spark.threadloom.vocabulary"
#: Fixed value: how that public vocabulary splits text before the merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts are encoded in blocks of about so many characters, cut before a space between two letters, where no token can reach across.
BLOCK = 100_000


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def blocks(text: str, size: int = BLOCK) -> Iterator[str]:
    """Pieces of a long text that encode independently to the tokens of the whole."""
    start = 0
    while len(text) - start > size:
        cut = start + size
        while cut < len(text) and not (text[cut] == " " and text[cut - 1].isalpha() and cut + 1 < len(text) and text[cut + 1].isalpha()):
            cut += 1
        yield text[start:cut]
        start = cut
    if start < len(text):
        yield text[start:]


def count_tokens(text: str | None, vocabulary: str = VOCABULARY) -> int:
    if not text:
        return 0
    encode = encoder(vocabulary).encode_ordinary
    return sum(len(encode(b)) for b in blocks(text))


def shipped(spark: SparkSession, vocabulary: str | None = None) -> str:
    """The name under which executors find the vocabulary: the file goes out from the driver, once for each session."""
    path = vocabulary or spark.conf.get(SETTING, VOCABULARY)
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def token_sizes(df: DataFrame, text: str, keep: list[str], vocabulary: str | None = None) -> DataFrame:
    """``keep`` and ``tokens``: the size of each text; null and empty texts have size 0. Whole texts are counted."""
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text"))
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField("tokens", T.LongType())])
    name = shipped(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = SparkFiles.get(name)
        for batch in batches:
            sizes = [count_tokens(t, path) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(sizes, pa.int64())], names=[*keep, "tokens"])

    return rows.mapInArrow(run, schema)
