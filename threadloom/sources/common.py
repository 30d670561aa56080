"""What every reader returns, and helpers to build it."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

#: One row per finding: an entity (name, kind, path, tldr, meta), a link (linkage, concept, name, weight) or evidence (linkage, concept, name, line,
#: detail).
RECORD = "what string, path string, kind string, name string, tldr string, meta string, linkage string, concept string, weight double, line int, detail string"
COLUMNS = [c.split()[0] for c in RECORD.split(", ")]


@dataclass
class Findings:
    """Collects what a parser finds in one file."""

    path: str
    rows: list[dict] = field(default_factory=list)

    def entity(self, name: str, kind: str, tldr: str | None = None, meta: str | None = None) -> None:
        self.rows.append({"what": "entity", "path": self.path, "name": name, "kind": kind, "tldr": tldr, "meta": meta})

    def link(self, linkage: str, concept: str, name: str, weight: float | None = None, line: int | None = None, detail: str | None = None) -> None:
        self.rows.append(
            {
                "what": "link", "path": self.path, "linkage": linkage, "concept": concept, "name": name, "weight": weight, "line": line,
                "detail": detail
            }
        )


def parsed(files: DataFrame, parse: Callable[[Findings, str], object]) -> DataFrame:
    """Findings of files (path, text), parsed file by file in batches. A file that can't be parsed gives an ``error`` row with the reason."""

    kinds = {"weight": pa.float64(), "line": pa.int32()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = Findings(path)
                try:
                    parse(found, text or "")
                except (SyntaxError, ValueError, RecursionError, KeyError, TypeError) as e:
                    found.rows = [{"what": "error", "path": path, "detail": f"{type(e).__name__}: {e}"[:300]}]
                rows += found.rows
            yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kinds.get(c, pa.string())) for c in COLUMNS], names=COLUMNS)

    return files.select("path", "text").mapInArrow(run, RECORD)


def entities_of(findings: DataFrame) -> DataFrame:
    return findings.filter("what = 'entity'").select("path", "kind", "name", "tldr", "meta").distinct()


def links_of(findings: DataFrame) -> DataFrame:
    """(linkage, concept, name, weight), each once; of several weights the largest."""
    from pyspark.sql import functions as F

    return findings.filter("what = 'link'").groupBy("linkage", "concept", "name").agg(F.max("weight").alias("weight"))
