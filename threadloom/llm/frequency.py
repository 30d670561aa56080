"""Frequency of every distinct value or term.

Pairs of term and record are sorted by range, across partitions and within each; a scan over the sorted
runs then counts, for every term, its occurrences and its distinct records. The ranges are cut by term *and*
record, so a term that a third of all records hold spreads over many partitions, and since equal pairs always meet in
one partition the record counts of the parts add up exactly.

Scale: occurrences are added up per record before the shuffle. The scan works on Arrow batches, holds one
batch at a time and emits one row per term and partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions.clean import folded

#: Identifiers as the engine indexes them: at least three characters, no leading digit.
TERM = r"[A-Za-z_][A-Za-z0-9_]{2,}"


def _changes(column: pa.Array) -> np.ndarray:
    """For every row but the first, whether it differs from the one before. The column has no nulls."""
    return pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)


def scan_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length scan over (field, term, record, n) sorted by term, field and record: (field, term, occurrences, records)."""
    schema = pa.schema([("field", pa.string()), ("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])
    held = None  # the run that may go on in the next batch: field, term, its last record, occurrences, records
    for batch in batches:
        if not batch.num_rows:
            continue
        field, term, record, n = (batch.column(i) for i in range(4))
        new_term = np.r_[True, _changes(term) | _changes(field)]
        new_record = new_term | np.r_[True, _changes(record)]
        first = np.flatnonzero(new_term)
        occurrences = np.add.reduceat(n.to_numpy(), first)
        records = np.add.reduceat(new_record.astype(np.int64), first)
        fields, terms = field.take(pa.array(first)).to_pylist(), term.take(pa.array(first)).to_pylist()
        if held and (held[0], held[1]) == (fields[0], terms[0]):
            occurrences[0] += held[3]
            records[0] += held[4] - (held[2] == record[0].as_py())
        elif held:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((held[0], held[1], held[3], held[4]), schema.types)], schema=schema)
        held = (fields[-1], terms[-1], record[batch.num_rows - 1].as_py(), int(occurrences[-1]), int(records[-1]))
        if len(first) > 1:
            yield pa.RecordBatch.from_arrays(
                [pa.array(fields[:-1], pa.string()), pa.array(terms[:-1], pa.string()), pa.array(occurrences[:-1]), pa.array(records[:-1])],
                schema=schema
            )
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((held[0], held[1], held[3], held[4]), schema.types)], schema=schema)


def value_pairs(df: DataFrame, field: str, value: str, record: str) -> DataFrame:
    """(field, term, record, n) of a column whose whole value, stripped and in lower case, is the term.

    Null and blank values and null records are left out. Rows repeated verbatim count once.
    """
    term = folded(F.col(f"`{value}`").cast("string"))
    rows = df.select(F.col(f"`{record}`").alias("record"), term.alias("term")).filter("record IS NOT NULL AND term != ''").distinct()
    return rows.select(F.lit(field).alias("field"), "term", "record", F.lit(1).cast("long").alias("n"))


def text_pairs(df: DataFrame, field: str, text: str, record: str, pattern: str = TERM) -> DataFrame:
    """(field, term, record, n) of the terms of a text column, n being the term's occurrences in the record.

    Null records and texts without a term give no rows. Rows repeated verbatim count once; different texts under
    one record all count, as one record. Whole texts are read, however long.
    """
    # One shuffle: what follows it needs the rows by record, and finds them so.
    rows = df.select(
        F.col(f"`{record}`").alias("record"), F.col(f"`{text}`").alias("text")
    ).filter("record IS NOT NULL AND text IS NOT NULL").repartition("record").distinct()
    terms = rows.select("record", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("term"))
    return terms.groupBy("record", F.lower("term").alias("term")).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(field).alias("field"), "term", "record", "n"
    )


def frequencies(pairs: DataFrame) -> DataFrame:
    """(field, term, occurrences, records) of (field, term, record, n) pairs, each pair as often as it comes."""
    # Terms first: sorts compare the first eight bytes of the first column before anything else.
    keys = ["term", "field", "record"]
    ordered = pairs.select("field", "term", "record", "n").repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = T.StructType(
        [
            T.StructField("field", T.StringType()), T.StructField("term", T.StringType()), T.StructField("occurrences", T.LongType()),
            T.StructField("records", T.LongType())
        ]
    )
    runs = ordered.mapInArrow(scan_runs, schema)
    return runs.groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked(counts: DataFrame, totals: DataFrame, common_share: dict[str, float], rare_records: int = 2) -> DataFrame:
    """Add ``mark``: ``rare`` up to ``rare_records`` records, else ``common`` from the field's share of its records, else ``kept``.

    ``totals`` has one row (field, total) for each field, and there are as many fields as ``common_share`` names.
    """
    share = F.coalesce(*[F.when(F.col("field") == f, F.lit(s)) for f, s in common_share.items()])
    mark = F.when(F.col("records") <= rare_records, "rare").when(F.col("records") >= share * F.col("total"), "common").otherwise("kept")
    return counts.join(F.broadcast(totals), "field").withColumn("mark", mark).drop("total")
