import json

import pytest
from conftest import rows
from threadloom.operators import dsl, reports
from threadloom.sources.ingest import ingest


def test_a_folder_becomes_a_graph(spark, tmp_path):
    (tmp_path / "a.py").write_text("import os\ndef parse(x):\n    return lex(x)\n")
    (tmp_path / "b.md").write_text("# Parsing\nThe parse function reads.\nrel: related-to -> [[lexer]]\n")
    (tmp_path / "bad.py").write_text("def (")
    (tmp_path / "calls.json").write_text(json.dumps({"edges": [{"from_file": "a.py", "from_func": "parse", "to_file": "c.py", "to_func": "lex"}]}))
    graph, tracked, errors = ingest(spark, str(tmp_path))
    names = {r.id: r.name for r in graph.entities.collect()}
    find = lambda q: {names[r[0]] for r in dsl.run(graph, q).collect()}
    assert find("defines:parse") == {"a.py::parse"} and find("calls:lex") == {"a.py::parse"} and find("defines:lex") == {"c.py::lex"}
    assert "b.md#parsing" in find("mentions:parse") and find("related-to:lexer") == {"b.md#parsing"}
    assert graph.evidence.count() > 0 and tracked.count() == 3 and graph.entities.count() == graph.entities.select("id").distinct().count()
    again, _, _ = ingest(spark, str(tmp_path))
    assert rows(again.links) == rows(graph.links)
    with pytest.raises(ValueError):
        ingest(spark, str(tmp_path), source="nope")


def test_derivations_and_commands(spark):
    stamps = spark.createDataFrame(
        [("a", "1", "h", 1.0), ("a", "2", "h", 2.0), ("b", "1", "x", 1.0), ("old", "1", "h", 1.0)],
        "pass_name string, version string, code_hash string, derived_at double"
    )
    now = spark.createDataFrame([("a", "2", "h"), ("b", "1", "h"), ("c", "1", "h")], "pass_name string, version string, code_hash string")
    assert rows(reports.derivation_state(stamps, now)) == [("a", "fresh"), ("b", "stale"), ("c", "never"), ("old", "unknown")]
    log = spark.createDataFrame(
        [(["q", "x"], None, 0, 5), (["q"], "end", 2, 7), (["q"], "start", None, None), (["z"], None, 0, None)],
        "argv array<string>, phase string, exit_code int, latency_ms int"
    )
    assert rows(reports.command_summary(log)) == [("q", 2, 1, 7, 7), ("z", 1, 0, None, None)]


def test_context_cost_and_usage(spark):
    log = spark.createDataFrame(
        [("s", "scan-prompt", 0.0, 10), ("s", "recall", 4.0, 5), ("s", "recall", 20.0, 7), ("s", "recall", 21.0, None)],
        "session string, command string, t double, out_bytes int"
    )
    by_command, by_prompt = reports.context_cost(log)
    assert {
        r.command: (r.n, r.unknown, r.total, r.mean, r.most) for r in by_command.collect()
    } == {"scan-prompt": (1, 0, 10, 10, 10), "recall": (3, 1, 12, 6, 7)}
    assert rows(by_prompt) == [("s", 0.0, 15)]
    calls = spark.createDataFrame(
        [("2026-01-01", "grep", "a", "hook", "ok", 5), ("2026-01-02", "grep", "b", None, "ok", 9), ("2026-01-03", "dsl", "b", "hook", "ok", 1)],
        "ts string, kind string, source string, invocation string, outcome string, latency_ms int"
    )
    got = {(r.dimension, r.key): r.n for r in reports.usage(calls, "2026-01-01", "2026-01-03").collect()}
    assert got == {("kind", "grep"): 2, ("source", "a"): 1, ("source", "b"): 1, ("invocation", "hook"): 1, ("outcome", "ok"): 2}


def test_sessions_and_vectors(spark):
    cards = spark.createDataFrame(
        [
            ("aaaaaaaa-1", "Fix parser", "/w/x", "main", "2026-01-02", ["do it"], ["abc1234"], ["p.py"]),
            ("aaaaaaaa-2", "Other", "/w/y", "dev", "2026-01-03", ["parser again"], [], [])
        ],
        "session string, title string, cwd string, branch string, last_ts string, prompts array<string>, commits array<string>, files array<string>"
    )
    assert [r.session for r in reports.recall_sessions(cards, "PARSER").collect()] == ["aaaaaaaa-2", "aaaaaaaa-1"]
    assert [r.session for r in reports.recall_sessions(cards, "parser", branch="main", commit="abc", touched="p.").collect()] == ["aaaaaaaa-1"]
    assert reports.show_session(cards, "aaaaaaaa-2").count() == 1 and reports.show_session(cards, "aaaa").count() == 0
    with pytest.raises(ValueError):
        reports.show_session(cards, "aaaaaaaa")
    old = spark.createDataFrame([(1, [1.0], 1.0), (2, [2.0], 1.0)], "id long, vector array<double>, updated_at double")
    new = spark.createDataFrame([(2, [3.0], 0.5), (3, [4.0], 1.0)], "id long, vector array<double>, updated_at double")
    assert [(r.id, r.vector[0]) for r in reports.upsert_vectors(old, new).orderBy("id").collect()] == [(1, 1.0), (2, 3.0), (3, 4.0)]
