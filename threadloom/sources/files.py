"""Trees of files: listing, ignoring, searching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.names import glob_pattern

# What is code, what is a document, and what is never read.
CODE = "py js ts tsx jsx go rs java kt c h cc cpp hpp cs rb php swift scala sh sql lua pseudo".split()
DOCS = "md markdown rst txt adoc".split()
IGNORED = ".git .hg .svn node_modules __pycache__ .venv venv dist build target .idea .vscode .pytest_cache .mypy_cache".split()


def kind_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin(CODE), "code").when(ext.isin(DOCS), "doc")


def ignored(path: Column, globs: Sequence[str] = ()) -> Column:
    """Whether a path lies in an ignored folder or matches a glob, as a whole or by its last part."""
    out = path.rlike(r"(^|/)(" + "|".join(x.replace(".", r"\.") for x in IGNORED) + r")(/|$)")
    for g in globs:
        g = g.rstrip("/")
        pattern = glob_pattern(g)[5:-1]
        out = out | path.rlike(rf"(?s)(^|/){pattern}(/|$)")
    return out


def tree(spark: SparkSession, root: str, globs: Sequence[str] = (), ignore: Sequence[str] = ()) -> DataFrame:
    """(path, mtime, length, text, kind) of the code and document files below a folder; paths are relative to it."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if globs:
        reader = reader.option("pathGlobFilter", globs[0])
    base = root.rstrip("/") + "/"
    rows = reader.load(root).withColumn("path", F.regexp_replace(F.col("path"), r"^file:/+", "/"))
    rows = rows.withColumn(
        "path", F.when(F.col("path").startswith(base), F.substring(F.col("path"), F.lit(len(base) + 1), F.length("path"))).otherwise(F.col("path"))
    )
    rows = rows.withColumn("kind", kind_of(F.col("path"))).filter(F.col("kind").isNotNull() & ~ignored(F.col("path"), ignore))
    return rows.select(
        "path", (F.unix_millis("modificationTime") / 1000.0).alias("mtime"), "length", F.decode(F.col("content"), "UTF-8").alias("text"), "kind"
    )


def changed(files: DataFrame, tracked: DataFrame) -> DataFrame:
    """Files that are new or whose time differs from the tracked one by more than a microsecond."""
    rows = files.join(tracked.select("path", F.col("mtime").alias("seen")), "path", "left")
    return rows.filter(F.col("seen").isNull() | (F.abs(F.col("mtime") - F.col("seen")) > 1e-6)).drop("seen")


def deleted(files: DataFrame, tracked: DataFrame) -> DataFrame:
    return tracked.join(files.select("path"), "path", "left_anti")


def lines_of(files: DataFrame) -> DataFrame:
    """(path, line_no from 1, line) of files (path, text)."""
    return files.select("path", F.posexplode(F.split("text", "\r?\n")).alias("n", "line")).select("path", (F.col("n") + 1).alias("line_no"), "line")


def grep(files: DataFrame, pattern: str, regex: bool = False, ignore_case: bool = True) -> DataFrame:
    """(path, line_no, line): lines that hold a text or match an expression."""
    line = F.col("line")
    if regex:
        hit = line.rlike(("(?i)" if ignore_case else "") + pattern)
    else:
        hit = F.lower(line).contains(pattern.lower()) if ignore_case else line.contains(pattern)
    return lines_of(files).filter(hit)


def verified(evidence: DataFrame, files: DataFrame, pattern: str, whole_word: bool = True) -> DataFrame:
    """Evidence (path, line, ...) whose file line really holds the pattern."""
    import re

    word = re.escape(pattern)
    at = lines_of(files).select("path", F.col("line_no").alias("line"), F.col("line").alias("text"))
    return evidence.join(at, ["path", "line"]).filter(F.col("text").rlike(rf"(?i)(?<!\w){word}(?!\w)" if whole_word else f"(?i){word}"))
