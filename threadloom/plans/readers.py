"""Source readers over whole tables: inputs are written from the tables in the readers' formats, read back, and compared with what the tables say.

A program reader gets one file for each code entity. ``{id}``, ``{p}`` and ``{m}`` in a text stand for the entity, its partition and
the entity modulo five; the expected links are written in the same way, so that the SQL twin needs no parser.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.clean import time_ms
from threadloom.graph import read
from threadloom.operators import vectors
from threadloom.plans.core_problems import TIME_SQL
from threadloom.sources import catalog, code, common, files, ingest, markdown, records, sessions
from threadloom.staging import new_path, put_file, spread, stage

Link = tuple[str, str, str, float | None]

PYTHON = '''"""Keeps the valve {m} ledger fresh, the ledger first."""
import os.path
from mod_{p} import thing
from . import near


class Box{id}(Base{m}, pkg.Other):
    """Holds valves_{m}."""

    def run(self, x):
        return helper_{m}(x) + len(x)


def top_{id}():
    def inner():
        pass

    print(run_{p}())
'''
PYTHON_LINKS: list[Link] = [
    ("mentions", "keyword/ledger", "{path}", 2.0), ("mentions", "keyword/keeps", "{path}", 1.0), ("mentions", "keyword/valve", "{path}", 1.0),
    ("mentions", "keyword/fresh", "{path}", 1.0), ("mentions", "keyword/first", "{path}", 1.0),
    ("imports", "import/os", "{path}", None), ("imports", "import/mod_{p}", "{path}", None),
    ("defines", "Box{id}", "{path}::Box{id}", None), ("has-part", "Box{id}", "{path}", None), ("is_a", "Base{m}", "{path}::Box{id}", None),
    ("is_a", "Other", "{path}::Box{id}", None),
    ("mentions", "keyword/holds", "{path}::Box{id}", 1.0), ("mentions", "keyword/valves_{m}", "{path}::Box{id}", 1.0),
    ("defines", "run", "{path}::Box{id}.run", None), ("has-part", "Box{id}.run", "{path}::Box{id}", None),
    ("calls", "helper_{m}", "{path}::Box{id}.run", None),
    ("defines", "top_{id}", "{path}::top_{id}", None), ("has-part", "top_{id}", "{path}", None), ("calls", "run_{p}", "{path}::top_{id}", None),
    ("defines", "inner", "{path}::top_{id}.inner", None), ("has-part", "top_{id}.inner", "{path}::top_{id}", None),
]
SQL = """-- CREATE TABLE hidden_{id} (x int);
CREATE SCHEMA IF NOT EXISTS depot_{p};
CREATE TABLE depot_{p}.bins_{id} (x int CHECK (fits_{m}(x) > 0));
/* CREATE VIEW hidden_v AS SELECT 1; */
CREATE UNIQUE INDEX bins_idx_{id} ON depot_{p}.bins_{id} (x);
CREATE OR REPLACE FUNCTION depot_{p}.fill_{id}(n int) RETURNS int AS $$
BEGIN
  -- FROM nowhere
  INSERT INTO audit_{m} SELECT count(*) FROM depot_{p}.bins_{id};
  x := weigh_{m}(lift_{p}(n));
  RETURN fill_{id}(n - 1);
END $$;
DO $$ BEGIN PERFORM sweep_{m}(1); END $$;
"""
SQL_LINKS: list[Link] = [
    ("defines", "depot_{p}", "{path}::depot_{p}", None), ("defines", "bins_{id}", "{path}::bins_{id}", None),
    ("defines", "bins_idx_{id}", "{path}::bins_idx_{id}", None), ("defines", "fill_{id}", "{path}::fill_{id}", None),
    ("mentions", "audit_{m}", "{path}::fill_{id}", 1.0), ("mentions", "bins_{id}", "{path}::fill_{id}", 1.0),
    ("calls", "weigh_{m}", "{path}::fill_{id}", None), ("calls", "lift_{p}", "{path}::fill_{id}", None),
    ("calls", "fits_{m}", "{path}", None), ("calls", "sweep_{m}", "{path}", None), ("calls", "bins_{id}", "{path}", None),
]
PSEUDO = """# depot {id}
from depot_{p} import Shelf
Crate{id}:
  content: list of Item{m}
  weight: float
Colour{id}:
  RED = 1
  Blue: Thing
move_{id}(c: Crate{id}, to: Shelf{m}) -> Receipt{p}:
  lift_{m}(c)
  move_{id}(c)
  r = Receipt{p}()
loose: x
  ignored(Me)
"""
PSEUDO_LINKS: list[Link] = [
    ("imports", "import/depot_{p}", "{path}", None), ("defines", "Crate{id}", "{path}::Crate{id}", None),
    ("mentions", "Item{m}", "{path}::Crate{id}", 1.0), ("defines", "Colour{id}", "{path}::Colour{id}", None),
    ("defines", "move_{id}", "{path}::move_{id}", None), ("mentions", "Crate{id}", "{path}::move_{id}", 1.0),
    ("mentions", "Shelf{m}", "{path}::move_{id}", 1.0), ("mentions", "Receipt{p}", "{path}::move_{id}", 1.0),
    ("calls", "lift_{m}", "{path}::move_{id}", None),
]
CALL_GRAPH = '{"edges": [{"from_file": "a{p}.py", "from_func": "f{id}", "to_file": "b{p}.py", "to_func": "g{m}"}, {"from_file": "a{p}.py", "from_func": "f{id}", "to_func": "free{m}"}, {"to_file": "c.py"}]}'
CALL_GRAPH_LINKS: list[Link] = [
    ("defines", "f{id}", "a{p}.py::f{id}", None), ("defines", "g{m}", "b{p}.py::g{m}", None), ("calls", "g{m}", "a{p}.py::f{id}", None),
    ("called_by", "f{id}", "b{p}.py::g{m}", None), ("calls", "free{m}", "a{p}.py::f{id}", None),
]
UNITS = (
    '{"path": "u{id}.py", "units": [{"name": "f{id}", "unit_type": "function", "calls": ["g{m}", "print", ""], "called_by": ["h{p}"], "imports": ["os.path", "os"], "dependencies": "json, mod{m}.sub"}, '
    '{"name": "C{id}", "unit_type": "class", "line": 9}]}'
)
UNITS_LINKS: list[Link] = [
    ("defines", "f{id}", "u{id}.py::f{id}", None), ("is_a", "kind/function", "u{id}.py::f{id}", None), ("calls", "g{m}", "u{id}.py::f{id}", None),
    ("called_by", "h{p}", "u{id}.py::f{id}", None),
    ("defines", "C{id}", "u{id}.py::C{id}", None), ("is_a", "kind/class", "u{id}.py::C{id}", None),
    ("imports", "import/os", "u{id}.py", None), ("imports", "import/json", "u{id}.py", None), ("imports", "import/mod{m}", "u{id}.py", None),
]
CROSS = (
    '{"nodes": [{"id": "n{id}", "label": "N"}, {"id": "t{m}", "file_type": "paper"}, {"label": "no id"}], "links": [{"source": "n{id}", "target": "t{m}", "relation": "uses", "weight": 2, "confidence": "INFERRED", "confidence_score": 0.5, '
    '"source_location": "L12-14"}, {"source": "t{m}", "target": "n{id}", "relation": "shares_data_with", "confidence": "AMBIGUOUS"}, {"source": "n{id}", "target": "gone", "relation": "uses"}, {"source": "n{id}", "target": "t{m}"}]}'
)
CROSS_LINKS: list[Link] = [("depends-on", "gf/n{id}", "graphify::t{m}", 0.5), ("shares_data_with", "gf/t{m}", "graphify::n{id}", 0.3)]
DECISION = """# Decision of depot {p}

**Status:** Proposed
**Governs:** Crate{id}, int32,
  Shelf_{m}
**Cross-references:** ADR-0003

## Context
As in ADR-0003 and ADR-0007.

+-- Box{id} (Crate{id}, Holder)

```
class Shelf{m}(Holder):
  place(c: Crate{id}) -> Receipt{m}
```
"""
DECISION_LINKS: list[Link] = [
    ("defines", "adr/{n}", "{path}", 0.9), ("mentions", "Crate{id}", "{path}", 0.3), ("mentions", "Shelf_{m}", "{path}", 0.3),
    ("related-to", "adr/0003", "{path}", 0.9), ("related-to", "adr/{n}", "adr/0003", 0.9),
    ("related-to", "adr/0007", "{path}", 0.9), ("related-to", "adr/{n}", "adr/0007", 0.9),
    ("defines", "Box{id}", "{path}::Box{id}", 0.9), ("is_a", "Crate{id}", "{path}::Box{id}", 0.9), ("is_a", "Holder", "{path}::Box{id}", 0.9),
    ("defines", "Shelf{m}", "{path}::Shelf{m}", 0.9), ("is_a", "Holder", "{path}::Shelf{m}", 0.9),
    ("mentions", "place", "{path}::Shelf{m}", 0.3), ("mentions", "Crate{id}", "{path}::Shelf{m}", 0.3),
    ("mentions", "Receipt{m}", "{path}::Shelf{m}", 0.3),
]
BOLD = "# Notes\n\n**Owner:** `team-{m}` and NightTeam\n- **Uses:** CrateStore{m}, `bins_{id}`\nplain **Word** text\n"
BOLD_LINKS: list[Link] = [
    ("mentions", "team-{m}", "{path}", 1.0), ("mentions", "NightTeam", "{path}", 1.0), ("mentions", "CrateStore{m}", "{path}", 1.0),
    ("mentions", "bins_{id}", "{path}", 1.0)
]
GRAPH_MARKDOWN = """---
id: spec-{id}
tags: [depot, shelf{m}]
kind: spec
---
# Crate design {#crate alias=[box{m}]}
Crates hold goods, crates stack.
rel: depends-on -> [[shelf-{m}]]
See [[ledger]] and `[[not this]]`.
```
# no heading
```
## Limits
More goods_{p}.
"""
GRAPH_MARKDOWN_LINKS: list[Link] = [
    ("mentions", "depot", "spec-{id}", 1.0), ("mentions", "shelf{m}", "spec-{id}", 1.0), ("part-of", "spec-{id}", "spec-{id}#crate", None),
    ("part-of", "spec-{id}#crate", "spec-{id}#limits", None),
    ("mentions", "Crate", "spec-{id}#crate", 2.0), ("mentions", "design", "spec-{id}#crate", 2.0), ("mentions", "box{m}", "spec-{id}#crate", 3.0),
    ("mentions", "crates", "spec-{id}#crate", 2.0), ("mentions", "hold", "spec-{id}#crate", 1.0),
    ("mentions", "goods", "spec-{id}#crate", 1.0), ("mentions", "stack", "spec-{id}#crate", 1.0), ("mentions", "see", "spec-{id}#crate", 1.0),
    ("mentions", "ledger", "spec-{id}#crate", 1.0),
    ("lead", "crates", "spec-{id}#crate", 1.0), ("lead", "hold", "spec-{id}#crate", 1.0), ("lead", "goods", "spec-{id}#crate", 1.0),
    ("lead", "stack", "spec-{id}#crate", 1.0), ("lead", "see", "spec-{id}#crate", 1.0), ("lead", "ledger", "spec-{id}#crate", 1.0),
    ("depends-on", "shelf-{m}", "spec-{id}#crate", 2.0), ("mentions", "Limits", "spec-{id}#limits", 2.0),
    ("mentions", "more", "spec-{id}#limits", 1.0), ("mentions", "goods_{p}", "spec-{id}#limits", 1.0),
    ("lead", "more", "spec-{id}#limits", 1.0), ("lead", "goods_{p}", "spec-{id}#limits", 1.0),
]
#: name: (path, text, parser, links).
FORMATS: dict[str, tuple[str, str, Callable, list[Link]]] = {
    "read_python": ("src/{p}/f{id}.py", PYTHON, code.parse_python, PYTHON_LINKS),
    "read_sql": ("src/{p}/f{id}.sql", SQL, code.parse_sql, SQL_LINKS),
    "read_pseudo": ("src/{p}/f{id}.pseudo", PSEUDO, code.parse_pseudo, PSEUDO_LINKS),
    "read_call_graph": ("graphs/{id}-calls.json", CALL_GRAPH, code.parse_call_graph, CALL_GRAPH_LINKS),
    "read_units": ("graphs/{id}-units.json", UNITS, code.parse_units, UNITS_LINKS),
    "read_cross_graph": ("graphs/{id}-cross.json", CROSS, code.parse_cross_graph, CROSS_LINKS),
    "read_decisions": ("docs/adr/{n}-crates-{id}.md", DECISION, records.parse_decision, DECISION_LINKS),
    "read_bold": ("notes/{id}.txt", BOLD, records.parse_bold, BOLD_LINKS),
    "read_graph_markdown": ("docs/{id}.md", GRAPH_MARKDOWN, markdown.parse, GRAPH_MARKDOWN_LINKS),
}
MARKS = {"{path}": None, "{id}": "id", "{p}": "p", "{m}": "m", "{n}": "n"}


def _filled(template: str, path: str) -> Column:
    out = F.lit(template.replace("{path}", path))
    for mark, name in MARKS.items():
        if name:
            out = F.replace(out, F.lit(mark), F.col(name))
    return out


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "entities").filter("kind = 'code'").select("id", F.col("partition_id").alias("p")).dropDuplicates(["id"])
    text = lambda c: c.cast("string")
    return e.select(
        text(F.col("id")).alias("id"), F.coalesce(text(F.col("p")), F.lit("0")).alias("p"), text(F.col("id") % 5).alias("m"),
        F.lpad(text(1000 + F.col("id") % 8999), 4, "0").alias("n")
    )


def _format_query(name: str):
    path, text, parser, _ = FORMATS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _entities(spark, sf_dir).select(_filled(path, path).alias("path"), _filled(text, path).alias("text"))
        return common.links_of(common.parsed(spread(rows), parser))

    run.__doc__ = f"Links of one file for each code entity ({path})."
    return run


_SRC = "SELECT CAST(id AS VARCHAR) AS id, coalesce(CAST(any_value(partition_id) AS VARCHAR), '0') AS p, CAST(id % 5 AS VARCHAR) AS m, lpad(CAST(1000 + id % 8999 AS VARCHAR), 4, '0') AS n FROM entities WHERE kind = 'code' GROUP BY id"


def _sql_filled(template: str, path: str) -> str:
    out = "'" + template.replace("{path}", path).replace("'", "''") + "'"
    for mark, name in MARKS.items():
        if name:
            out = f"replace({out}, '{mark}', {name})"
    return out


def _links_sql(name: str, source: str = _SRC) -> str:
    path, _, _, links = FORMATS[name]
    rows = [
        f"SELECT '{v}' AS linkage, {_sql_filled(c, path)} AS concept, {_sql_filled(e, path)} AS name, CAST({'NULL' if w is None else w} AS DOUBLE) AS weight FROM s"
        for v,
        c, e, w in links
    ]
    return f"WITH s AS ({source}), l AS ({' UNION ALL '.join(rows)}) SELECT linkage, concept, name, max(weight) AS weight FROM l GROUP BY ALL"


FOLDER = ("7", "3", "2", "1006")


def ingest_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder with one file of each format, one that can't be parsed and one in an ignored folder, as the links of a graph."""
    root = new_path(spark, "folder")
    fill = lambda t: t.replace("{id}", FOLDER[0]).replace("{p}", FOLDER[1]).replace("{m}", FOLDER[2]).replace("{n}", FOLDER[3])
    for name, (path, text, _, _) in FORMATS.items():
        if name != "read_bold":
            put_file(spark, f"{root}/{fill(path)}", fill(text).replace("{path}", fill(path)))
    for path, text in (
        ("src/broken.py", "def broken("), ("src/what.json", '{"what": 1}'), ("node_modules/x.py", "def hidden(): pass"), ("notes/plain.txt", "words")
    ):
        put_file(spark, f"{root}/{path}", text)
    graph, _, errors = ingest.ingest(spark, root.removeprefix("file://"))
    e = graph.entities.select("id", "name")
    links = graph.links.join(
        e.select(F.col("id").alias("concept_id"), F.col("name").alias("concept")), "concept_id"
    ).join(e.withColumnRenamed("id", "entity_id"), "entity_id")
    failed = errors.select(
        F.lit("error").alias("linkage"), F.substring_index("detail", ":", 1).alias("concept"), F.col("path").alias("name"),
        F.lit(None).cast("double").alias("weight")
    )
    return links.select("linkage", "concept", "name", "weight").unionByName(failed)


def _folder_sql() -> str:
    src = "SELECT " + ", ".join(f"'{v}' AS {k}" for k, v in zip(("id", "p", "m", "n"), FOLDER))
    parts = [f"SELECT * FROM ({_links_sql(n, src)})" for n in FORMATS if n != "read_bold"]
    known = "SELECT 'error' AS linkage, 'SyntaxError' AS concept, 'src/broken.py' AS name, CAST(NULL AS DOUBLE) AS weight UNION ALL SELECT 'error', 'ValueError', 'src/what.json', NULL"
    return f"SELECT linkage, concept, name, max(weight) AS weight FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL UNION ALL {known}"


# --- trees of files ---------------------------------------------------------------------------------------


def _document_folder(spark: SparkSession, sf_dir: str) -> str:
    """The documents as text files, one folder for each partition."""
    root = new_path(spark, "documents")
    rows = read(spark, sf_dir, "documents").filter("text IS NOT NULL").select("text", F.coalesce("partition_id", F.lit(0)).alias("part"))
    rows.repartition("part").write.partitionBy("part").text(root)
    return root.removeprefix("file://")


def _part() -> Column:
    return F.regexp_extract("path", r"part=(\d+)/", 1).cast("int")


def read_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of text files by folder, without an ignored folder."""
    rows = files.tree(spark, _document_folder(spark, sf_dir), ignore=["part=7", "part=1?"])
    return rows.groupBy(_part().alias("part"), "kind").agg(F.sum("length").alias("bytes"))


def grep_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the files that hold a word, by folder."""
    rows = files.grep(files.tree(spark, _document_folder(spark, sf_dir)), "WaterMark")
    return rows.groupBy(_part().alias("part")).agg(F.count(F.lit(1)).alias("n"))


def tracked_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are new, changed or gone against a list of tracked ones: the copy of the entities as files, the store as the list."""
    stamp = lambda t: read(spark, sf_dir, t).filter("path != ''").groupBy("path").agg(F.max("created_at").alias("mtime"))
    now, seen = stamp("entities_replica"), stamp("entities")
    new = files.changed(now, seen).select("path", F.lit("changed").alias("what"))
    return new.unionByName(
        files.deleted(now, seen).select("path", F.lit("gone").alias("what"))
    ).groupBy("what").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first"))


# --- logs and transcripts -----------------------------------------------------------------------------------


def read_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query log as JSON lines with lines that aren't JSON between, from a time on."""
    path = new_path(spark, "telemetry")
    rows = read(spark, sf_dir, "query_log").select(
        "ts", "kind", "source", "invocation", "body", "cardinality", "latency_ms", "outcome", "answered_by", "error"
    )
    broken = spark.range(20).select(F.concat(F.lit("{broken "), F.col("id").cast("string")).alias("value"))
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).unionByName(broken).write.text(path)
    kept = sessions.json_lines(spark, path, sessions.TELEMETRY, since="2026-03")
    return kept.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("latency_ms").alias("timed"), F.max("ts").alias("last"))


def _transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query log as transcripts: every call a prompt, one with an outcome a tool call, one with an error a failed one."""
    path = new_path(spark, "transcripts")
    rows = read(spark, sf_dir, "query_log").select(
        "query_id", F.col("root").alias("cwd"), time_ms(F.col("ts")).alias("ms"), "body", "outcome", F.col("error").isNotNull().alias("failed")
    ).filter("ms IS NOT NULL AND body IS NOT NULL").distinct()
    stamp = F.date_format(F.timestamp_millis("ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    session = F.concat(F.lit("s-"), F.substring(F.sha2("cwd", 256), 1, 12))

    def line(kind: str, content: Column) -> Column:
        message = F.struct(F.lit(kind).alias("role"), content.alias("content"), F.lit("m1").alias("model"))
        return F.to_json(
            F.struct(F.lit(kind).alias("type"), message.alias("message"), stamp.alias("timestamp"), F.col("cwd"), session.alias("sessionId"))
        )

    block = lambda **kv: F.to_json(F.array(F.struct(*[v.alias(k) for k, v in kv.items()])))
    call = F.when(F.col("outcome").isNotNull(), line("assistant", block(type=F.lit("tool_use"), name=F.col("outcome"), id=F.col("query_id"))))
    back = F.when(
        F.col("outcome").isNotNull(), line("user", block(type=F.lit("tool_result"), tool_use_id=F.col("query_id"), is_error=F.col("failed")))
    )
    lines = rows.select(
        session.alias("session"), "ms", "query_id",
        F.posexplode(F.array_compact(F.array(line("user", F.col("body")), call, back))).alias("n", "value")
    )
    lines.repartition("session").sortWithinPartitions("session", "ms", "query_id", "n").select("value").write.text(path)
    return stage(sessions.transcript(spark, path), "transcript")


def read_session_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One card for each project root of the query log."""
    cards = sessions.session_cards(_transcripts(spark, sf_dir))
    return cards.select(
        "session", "cwd", "first_ts", "last_ts", "turns", F.size("prompts").alias("prompts"), F.size(F.map_keys("tool_counts")).alias("tools")
    )


def read_transcript_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns, tool calls and errors of the same transcripts."""
    return sessions.tree_stats(_transcripts(spark, sf_dir)).drop("tool_counts")


# --- catalogs ---------------------------------------------------------------------------------------------------


def migrate_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables written in the store's own layout and read back by partition."""
    target = new_path(spark, "migrated")
    catalog.migrate({"entities": read(spark, sf_dir, "entities"), "memory_content": read(spark, sf_dir, "memory_content")}, target)
    e = spark.read.parquet(f"{target}/entities.parquet").groupBy(F.col("partition_id").cast("int").alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.count("tldr").alias("described")
    )
    m = spark.read.parquet(f"{target}/memory_content.parquet").select(F.lit(-1).alias("part")).groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.lit(1)).alias("described")
    )
    return e.unionByName(m)


def catalog_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories of the catalog with their entities, of some types."""
    e = read(spark, sf_dir, "entities").distinct().filter("kind = 'memory'").select(F.col("id").alias("entity_id"), "name", "partition_id")
    return e.join(
        read(spark, sf_dir, "memory_content").distinct().filter("mtype IN ('feedback', 'note', 'decision')").select("entity_id", "mtype"), "entity_id"
    )


def vector_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the ids of the documents, as many as there are."""
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = vectors.read_vectors(v, read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")))
    return found.select("id", F.size("vector").alias("dims"))


QUERIES = {name: _format_query(name) for name in FORMATS} | {
    f.__name__: f
    for f in (
        ingest_folder, read_tree, grep_files, tracked_changes, read_json_lines, read_session_cards, read_transcript_tree, migrate_catalog,
        catalog_scan, vector_scan
    )
}
_CALLS = f"""
WITH c AS (SELECT DISTINCT query_id, root AS cwd, {TIME_SQL} AS ms, body, outcome, error IS NOT NULL AS failed FROM query_log WHERE body IS NOT NULL),
s AS (SELECT *, 's-' || substr(sha256(cwd), 1, 12) AS session, strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS stamp, lag(body) OVER (PARTITION BY cwd ORDER BY ms, query_id) AS before FROM c WHERE ms IS NOT NULL)
"""
ORACLE = {name: _links_sql(name) for name in FORMATS} | {
    "ingest_folder": _folder_sql(),
    "read_tree": "SELECT coalesce(partition_id, 0) AS part, 'doc' AS kind, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes FROM documents WHERE text IS NOT NULL AND NOT regexp_full_match(CAST(coalesce(partition_id, 0) AS VARCHAR), '7|1.') GROUP BY 1",
    "grep_files": "SELECT part, count(*) AS n FROM (SELECT coalesce(partition_id, 0) AS part, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE contains(lower(line), 'watermark') GROUP BY 1",
    "tracked_changes": "WITH a AS (SELECT path, max(created_at) AS t FROM entities_replica WHERE path <> '' GROUP BY 1), b AS (SELECT path, max(created_at) AS t FROM entities WHERE path <> '' GROUP BY 1), "
    "r AS (SELECT 'changed' AS what, a.path FROM a LEFT JOIN b USING (path) WHERE b.path IS NULL OR abs(a.t - b.t) > 1e-6 UNION ALL SELECT 'gone', path FROM b WHERE path NOT IN (SELECT path FROM a)) SELECT what, count(*) AS n, min(path) AS first FROM r GROUP BY 1",
    "read_json_lines": "SELECT kind, count(*) AS n, count(latency_ms) AS timed, max(ts) AS last FROM query_log WHERE ts >= '2026-03' GROUP BY 1",
    "read_session_cards": _CALLS
    + "SELECT session, any_value(cwd) AS cwd, min(stamp) AS first_ts, max(stamp) AS last_ts, count(*) AS turns, count(*) FILTER (WHERE before IS DISTINCT FROM body) AS prompts, count(DISTINCT outcome) AS tools FROM s GROUP BY session",
    "read_transcript_tree": _CALLS
    + "SELECT session, count(*) AS turns, count(outcome) AS actions, count(*) FILTER (WHERE outcome IS NOT NULL AND failed) AS errors FROM s GROUP BY session",
    "migrate_catalog": "SELECT partition_id AS part, count(*) AS n, count(tldr) AS described FROM entities GROUP BY 1 UNION ALL SELECT -1, count(*), count(*) FROM memory_content",
    "catalog_scan": "SELECT e.id AS entity_id, name, partition_id, mtype FROM (SELECT DISTINCT * FROM entities WHERE kind = 'memory') e JOIN (SELECT DISTINCT * FROM memory_content) m ON m.entity_id = e.id WHERE mtype IN ('feedback', 'note', 'decision')",
    "vector_scan": "SELECT vec_id AS id, len(embedding) AS dims FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)",
}
