"""Queries of the general problems: sessions (p2) and differences between copies (p7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.clean import folded, is_blank, time_ms
from threadloom.operators.diff import diff_copies, left_over
from threadloom.operators.sessions import GAP_MS, sessions

ENTITY_FIELDS = {
    "partition_id": "exact", "kind": "exact", "path": "exact", "name": "exact", "tldr": "exact", "meta": "json", "created_at": "epoch",
    "updated_at": "epoch", "protected": "exact", "noise": "exact",
    "canonical_name": "exact", "vectors_updated_at": "epoch",
}
MEMORY_FIELDS = {"content": "exact", "mtype": "exact", "tags": "json", "metadata": "json", "created_at": "epoch", "updated_at": "epoch"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls of the query log, each once: root, invocation, ms."""
    invocation = folded(F.col("invocation"))
    return (
        read(spark, sf_dir, "query_log")
        .select(
            "query_id", F.rtrim(F.col("root"), F.lit("/")).alias("root"),
            F.when(is_blank(F.col("invocation")), "unknown").otherwise(invocation).alias("invocation"), time_ms(F.col("ts")).alias("ms")
        )
        .filter("ms IS NOT NULL")
        .distinct()
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(calls(spark, sf_dir), ["root", "invocation"], "ms", GAP_MS).withColumnRenamed("n_events", "n_calls")


def p2_session_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, calls and durations of the sessions of every root."""
    duration = F.col("end_ms") - F.col("start_ms")
    return p2_found(spark, sf_dir).groupBy("root").agg(
        F.count(F.lit(1)).alias("n_sessions"), F.sum("n_calls").alias("n_calls"), F.max(duration).alias("longest_ms"),
        F.sum(duration).alias("active_ms")
    )


COPIES = (("entities", "entities_replica", "id", ENTITY_FIELDS), ("memory_content", "memory_replica", "entity_id", MEMORY_FIELDS))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between the newest versions of the two tables and their copies."""
    parts = []
    for table, copy, key, fields in COPIES:
        report = diff_copies(read(spark, sf_dir, table), read(spark, sf_dir, copy), key, fields, version="updated_at")
        parts.append(report.select(F.lit(table).alias("tbl"), "row_id", "field"))
    return parts[0].unionByName(parts[1]).distinct()


def p7_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables and their copies compared row by row, every delivery and version counted."""
    parts = [
        diff_copies(read(spark, sf_dir, t), read(spark, sf_dir, c), key, fields, once=False).select(F.lit(t).alias("tbl"), "row_id", "field", "n")
        for t,
        c, key, fields in COPIES
    ]
    return parts[0].unionByName(parts[1])


def p7_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each id don't cancel, on either side: what goes into the assignment of p7_multiset."""
    parts = []
    for table, copy, key, fields in COPIES:
        left = left_over(read(spark, sf_dir, table), read(spark, sf_dir, copy), key, fields, once=False)
        parts.append(
            left.groupBy(F.col("k").alias("row_id")).agg(
                F.sum("n1").alias("left_main"), F.sum("n0").alias("left_copy")
            ).withColumn("tbl", F.lit(table))
        )
    return parts[0].unionByName(parts[1])


TIME_SQL = r"""CASE WHEN regexp_full_match(ts, '\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})?')
     THEN epoch_ms(try_cast(CASE WHEN regexp_matches(ts, '(Z|[+-]\d{2}:?\d{2})$') THEN ts ELSE ts || 'Z' END AS TIMESTAMPTZ))
     WHEN regexp_full_match(ts, '\d+') THEN try_cast(ts AS BIGINT) * 1000 END"""

SESSIONS_SQL = rf"""
WITH c AS (
  SELECT DISTINCT query_id, regexp_replace(root, '/+$', '') AS root,
         CASE WHEN invocation IS NULL OR trim(invocation) = '' THEN 'unknown' ELSE lower(trim(invocation)) END AS invocation, {TIME_SQL} AS ms
  FROM query_log),
o AS (SELECT *, lag(ms) OVER (PARTITION BY root, invocation ORDER BY ms) AS before FROM c WHERE ms IS NOT NULL),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR ms - before > 1800000 THEN 1 ELSE 0 END) OVER (PARTITION BY root, invocation ORDER BY ms RANGE UNBOUNDED PRECEDING) AS n FROM o),
found AS (SELECT root, invocation, min(ms) AS start_ms, max(ms) AS end_ms, count(*) AS n_calls FROM s GROUP BY root, invocation, n)
"""


_SECONDS = "CASE WHEN {x} > 1e11 THEN {x} / 1000 ELSE {x} END"


def _left_sql(table: str, copy: str, key: str, fields: dict[str, str]) -> str:
    """Rows that don't cancel, by id. A JSON object is its sorted pairs, as json(x) alone keeps the order of keys."""
    forms = {
        "epoch": _SECONDS,
        "exact": "CAST({x} AS VARCHAR)",
        "json": "CASE WHEN json_valid({x}) AND json_type({x}) = 'OBJECT' THEN CAST(list_sort(list_transform(json_keys({x}), lambda k: k || '=' || CAST(json_extract({x}, '$.\"' || k || '\"') AS VARCHAR))) AS VARCHAR) "
        "WHEN json_valid({x}) THEN CAST(json({x}) AS VARCHAR) ELSE {x} END",
    }
    cols = ", ".join(f"{forms[kind].format(x=c)} AS f{i}" for i, (c, kind) in enumerate(fields.items()))
    names = ", ".join(f"f{i}" for i in range(len(fields)))
    return (
        f"SELECT '{table}' AS tbl, row_id, CAST(sum(greatest(n1 - n0, 0)) AS BIGINT) AS left_main, CAST(sum(greatest(n0 - n1, 0)) AS BIGINT) AS left_copy FROM ("
        f"SELECT row_id, {names}, sum(m) AS n1, sum(1 - m) AS n0 FROM (SELECT {key} AS row_id, 1 AS m, {cols} FROM {table} UNION ALL SELECT {key}, 0, {cols} FROM {copy}) GROUP BY ALL) WHERE n1 <> n0 GROUP BY row_id"
    )


def _changes_sql(table: str, copy: str, key: str, fields: dict[str, str]) -> str:
    # json(x) alone keeps the order of keys; the pairs of an object are sorted instead.
    same_json = (
        "CASE WHEN json_valid(a.{c}) AND json_valid(b.{c}) THEN CASE WHEN json_type(a.{c}) = 'OBJECT' AND json_type(b.{c}) = 'OBJECT' "
        "THEN list_sort(list_transform(json_keys(a.{c}), lambda k: k || '=' || CAST(json_extract(a.{c}, '$.\"' || k || '\"') AS VARCHAR))) = list_sort(list_transform(json_keys(b.{c}), lambda k: k || '=' || CAST(json_extract(b.{c}, '$.\"' || k || '\"') AS VARCHAR))) "
        "ELSE CAST(json(a.{c}) AS VARCHAR) = CAST(json(b.{c}) AS VARCHAR) END ELSE a.{c} = b.{c} END"
    )
    s = _SECONDS
    tests = []
    for c, kind in fields.items():
        if kind == "epoch":
            test = f"(a.{c} IS NULL) <> (b.{c} IS NULL) OR coalesce(abs(({s.format(x='a.' + c)}) - ({s.format(x='b.' + c)})) > 0.01, false)"
        elif kind == "json":
            test = f"(a.{c} IS NULL) <> (b.{c} IS NULL) OR (a.{c} IS NOT NULL AND b.{c} IS NOT NULL AND NOT ({same_json.format(c=c)}))"
        else:
            test = f"a.{c} IS DISTINCT FROM b.{c}"
        tests.append(
            f"SELECT '{table}' AS tbl, a.{key} AS row_id, '{c}' AS field FROM {table}_m a JOIN {table}_c b ON a.{key} = b.{key} WHERE {test}"
        )
    newest = "SELECT * FROM (SELECT DISTINCT * FROM {t}) QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY " + s.format(x="updated_at") + " DESC NULLS LAST) = 1"
    return (
        f"{table}_m AS ({newest.format(t=table, k=key)}), {table}_c AS ({newest.format(t=copy, k=key)}), {table}_d AS ("
        + " UNION ALL ".join(tests)
        + f" UNION ALL SELECT '{table}', {key}, 'missing_in_copy' FROM {table}_m WHERE {key} NOT IN (SELECT {key} FROM {table}_c)"
        + f" UNION ALL SELECT '{table}', {key}, 'missing_in_main' FROM {table}_c WHERE {key} NOT IN (SELECT {key} FROM {table}_m))"
    )


QUERIES = {f.__name__: f for f in (p2_found, p2_session_stats, p7_found, p7_multiset, p7_left)}
ORACLE = {
    "p2_found": SESSIONS_SQL + "SELECT root, invocation, start_ms, end_ms, n_calls FROM found",
    "p2_session_stats": SESSIONS_SQL
    + "SELECT root, count(*) AS n_sessions, CAST(sum(n_calls) AS BIGINT) AS n_calls, max(end_ms - start_ms) AS longest_ms, CAST(sum(end_ms - start_ms) AS BIGINT) AS active_ms FROM found GROUP BY root",
    "p7_found": "WITH "
    + _changes_sql("entities", "entities_replica", "id", ENTITY_FIELDS)
    + ", "
    + _changes_sql("memory_content", "memory_replica", "entity_id", MEMORY_FIELDS)
    + " SELECT * FROM entities_d UNION ALL SELECT * FROM memory_content_d",
    "p7_left": " UNION ALL ".join(_left_sql(*c) for c in COPIES),
}
