import json

from conftest import rows
from threadloom.sources import code, common, files, markdown, records, sessions


def parse(spark, parser, text, path="f.md"):
    found = common.parsed(spark.createDataFrame([(path, text)], "path string, text string"), parser)
    return {tuple(r) for r in common.links_of(found).collect()}, {r.name for r in common.entities_of(found).collect()}, found


def test_markdown_tree_relations_and_terms(spark):
    text = "---\nid: spec-1\ntags: [graph, index]\n---\n# Parser design {#parser alias=[lexer]}\nThe parser reads tokens tokens.\nrel: depends-on -> [[tokenizer]]\nSee [[grammar]] and `[[not this]]`.\n```\n# not a heading\n```\n## Details\nmore\n"
    links, entities, _ = parse(spark, markdown.parse, text)
    assert entities == {"spec-1", "spec-1#parser", "spec-1#details"}
    assert ("part-of", "spec-1", "spec-1#parser", None) in links and ("part-of", "spec-1#parser", "spec-1#details", None) in links
    assert ("depends-on", "tokenizer", "spec-1#parser", 1.0) in links and ("mentions", "grammar", "spec-1#parser", 1.0) in links
    assert (
        "mentions", "tokens", "spec-1#parser", 2.0
    ) in links and ("mentions", "lexer", "spec-1#parser", 3.0) in links and ("mentions", "graph", "spec-1", 1.0) in links
    assert ("lead", "parser", "spec-1#parser", 1.0) in links and not any("not this" in str(x) for x in links)


def test_python(spark):
    text = '"""Reads graphs."""\nimport os.path\nfrom json import loads\n\nclass A(Base):\n    def run(self, x):\n        return helper(x)\n'
    links, entities, found = parse(spark, code.parse_python, text, "a.py")
    assert {"a.py", "a.py::A", "a.py::A.run"} <= entities
    assert {
        ("imports", "import/os", "a.py", None), ("imports", "import/json", "a.py", None), ("defines", "run", "a.py::A.run", None),
        ("calls", "helper", "a.py::A.run", None), ("is_a", "Base", "a.py::A", None), ("mentions", "keyword/graphs", "a.py", 1.0)
    } <= links
    assert parse(spark, code.parse_python, "def broken(", "b.py")[2].filter("what = 'error'").count() == 1


def test_sql(spark):
    text = "CREATE TABLE depot.bins(id int CHECK (fits(id)));\n-- CREATE TABLE ghost(id int);\nCREATE FUNCTION refill() RETURNS void AS $f$ BEGIN INSERT INTO ledger SELECT max(id) FROM depot.bins; x := weigh(lift(1)); PERFORM refill(); END $f$;\nSELECT sweep(1);"
    links, entities, _ = parse(spark, code.parse_sql, text, "s.sql")
    assert entities == {"s.sql", "s.sql::bins", "s.sql::refill"}
    assert links == {
        ("defines", "bins", "s.sql::bins", None), ("defines", "refill", "s.sql::refill", None), ("mentions", "ledger", "s.sql::refill", 1.0),
        ("mentions", "bins", "s.sql::refill", 1.0), ("calls", "weigh", "s.sql::refill", None),
        ("calls", "lift", "s.sql::refill", None), ("calls", "fits", "s.sql", None), ("calls", "sweep", "s.sql", None),
    }


def test_pseudo_call_graph_units_and_cross_graph(spark):
    links, _, _ = parse(
        spark, code.parse_pseudo,
        "from net import get, put\nNode:\n  next: Node\n  left: list of Leaf\nColour:\n  RED = 1\n  Blue: Thing\nwalk(n: Node,\n     m: Leaf)\n  visit(n)\n  walk(n)\nrest = Other\n  lost(Me)\n",
        "p.pseudo"
    )
    assert links == {
        ("imports", "import/net", "p.pseudo", None), ("defines", "Node", "p.pseudo::Node", None), ("mentions", "Node", "p.pseudo::Node", 1.0),
        ("mentions", "Leaf", "p.pseudo::Node", 1.0), ("defines", "Colour", "p.pseudo::Colour", None),
        ("defines", "walk", "p.pseudo::walk", None), ("calls", "visit", "p.pseudo::walk", None), ("mentions", "Leaf", "p.pseudo::walk", 1.0),
    }
    graph = json.dumps({"edges": [{"from_file": "a.py", "from_func": "f", "to_file": "b.py", "to_func": "g"}, {"to_file": "b.py"}, {}]})
    links, _, _ = parse(spark, code.parse_call_graph, graph)
    assert links == {
        ("defines", "f", "a.py::f", None), ("defines", "g", "b.py::g", None), ("calls", "g", "a.py::f", None), ("called_by", "f", "b.py::g", None)
    }
    units = json.dumps(
        {
            "path": "m.py",
            "units": [
                {"name": "f", "unit_type": "function", "calls": ["g", "print", None], "imports": ["os.path", "os"], "dependencies": " json.decoder, "}
            ]
        }
    )
    links, _, _ = parse(spark, code.parse_units, units)
    assert links == {
        ("defines", "f", "m.py::f", None), ("is_a", "kind/function", "m.py::f", None), ("calls", "g", "m.py::f", None),
        ("imports", "import/os", "m.py", None), ("imports", "import/json", "m.py", None)
    }
    cross = json.dumps(
        {
            "nodes": [{"id": "a", "label": "A"}, {"id": "b"}],
            "edges": [
                {"source": "a", "target": "b", "relation": "uses", "weight": 2, "confidence": "INFERRED", "confidence_score": 0.5},
                {"source": "a", "target": "c", "relation": "uses"}
            ]
        }
    )
    links, entities, _ = parse(spark, code.parse_cross_graph, cross)
    assert links == {("depends-on", "gf/a", "graphify::b", 0.5)} and entities == {"graphify::a", "graphify::b"}


def test_decision_record(spark):
    text = "# ADR 7: Keep graphs\n\n- **Status:** Accepted\n- **Governs:** GraphStore,\n  LinkTable\n- **Supersedes:** ADR-0003\n\n## Context\n+-- Leaf (Node)\n```\nclass GraphStore(Store):\n  put(l: LinkTable)\n```\n"
    links, _, _ = parse(spark, records.parse_decision, text, "docs/adr-0007.md")
    assert {
        ("defines", "adr/0007", "docs/adr-0007.md", 3.0), ("mentions", "GraphStore", "docs/adr-0007.md", 1.0),
        ("mentions", "LinkTable", "docs/adr-0007.md", 1.0), ("related-to", "adr/0003", "docs/adr-0007.md", 3.0),
        ("related-to", "adr/0007", "adr/0003", 3.0), ("is_a", "Store", "docs/adr-0007.md::GraphStore", 3.0),
        ("mentions", "LinkTable", "docs/adr-0007.md::GraphStore", 1.0), ("mentions", "put", "docs/adr-0007.md::GraphStore", 1.0),
        ("is_a", "Node", "docs/adr-0007.md::Leaf", 3.0),
    } == links - {x for x in links if x[1] in ("GraphStore", "Leaf") and x[0] == "defines"}


def test_files_and_grep(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1\nNeedle here\n")
    (tmp_path / "src/skip.md").write_text("needle")
    (tmp_path / "node_modules/b.py").write_text("needle")
    (tmp_path / "c.bin").write_bytes(b"needle")
    tree = files.tree(spark, str(tmp_path), ignore=["skip*"])
    assert rows(tree.select("path", "kind")) == [("src/a.py", "code")]
    assert rows(files.grep(tree, "needle")) == [("src/a.py", 2, "Needle here")]
    assert files.grep(tree, "needle", ignore_case=False).count() == 0
    tracked = tree.select("path", "mtime")
    assert files.changed(tree, tracked).count() == 0 and files.changed(tree, tracked.limit(0)).count() == 1
    assert files.deleted(tree.limit(0), tracked).count() == 1
    evidence = spark.createDataFrame([("src/a.py", 2, "e"), ("src/a.py", 1, "f")], "path string, line int, detail string")
    assert rows(files.verified(evidence, tree, "needle").select("detail")) == [("e",)]


def test_session_cards_and_actions(spark, tmp_path):
    lines = [
        {
            "type": "user", "message": {"role": "user", "content": "fix 0a1b2c3d"}, "timestamp": "2026-01-01T00:00:00Z", "cwd": "/w",
            "gitBranch": "main"
        },
        {
            "type": "assistant",
            "message": {
                "role": "assistant", "model": "m1",
                "content": json.dumps(
                    [{"type": "text", "text": "ok"}, {"type": "tool_use", "name": "Edit", "id": "t1", "input": {"file_path": "a.py"}}]
                )
            },
            "timestamp": "2026-01-01T00:00:01Z"
        },
        {
            "type": "user", "message": {"role": "user", "content": json.dumps([{"type": "tool_result", "tool_use_id": "t1", "is_error": True}])},
            "timestamp": "2026-01-01T00:00:02Z"
        },
        {"type": "user", "message": {"role": "user", "content": "again"}, "timestamp": "2026-01-01T00:00:03Z"},
        {"type": "user", "message": {"role": "user", "content": "again"}, "timestamp": "2026-01-01T00:00:04Z"},
        {"type": "ai-title", "aiTitle": "A fix"},
    ]
    (tmp_path / "s1.jsonl").write_text("\n".join(map(json.dumps, lines)))
    t = sessions.transcript(spark, str(tmp_path))
    card = sessions.session_cards(t).first()
    assert (card.session, card.title, card.cwd, card.branch, card.turns, card.prompts) == ("s1", "A fix", "/w", "main", 3, ["fix 0a1b2c3d", "again"])
    assert card.tool_counts == {"Edit": 1} and card.files == ["a.py"] and card.commits == ["0a1b2c3d"] and card.models == ["m1"]
    stats = sessions.tree_stats(t).first()
    assert (stats.turns, stats.actions, stats.errors, stats.tool_counts) == (3, 1, 1, {"Edit": 1})
    action = sessions.actions(t).first()
    assert (action.turn, action.tool, action.error) == (1, "Edit", True)


def test_json_lines_keep_bad_rows(spark, tmp_path):
    (tmp_path / "q.log").write_text('{"ts": "2026-01-02", "kind": "grep", "latency_ms": 5}\nnot json\n{"ts": "2026-01-01", "kind": "grep"}\n')
    got = sessions.json_lines(spark, str(tmp_path), sessions.TELEMETRY).cache()
    assert got.count() == 3 and got.filter("_bad IS NOT NULL").count() == 1
    assert sessions.json_lines(spark, str(tmp_path), sessions.TELEMETRY, since="2026-01-02").count() == 1


def test_a_table_over_jdbc(spark, tmp_path):
    from threadloom.sources import catalog

    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.range(50).selectExpr("id AS key", "id * 2 AS twice").write.format("jdbc").options(url=url, dbtable="t").save()
    got = catalog.jdbc_table(spark, url, "t", "key", (0, 50), 4)
    assert got.rdd.getNumPartitions() == 4 and got.agg({"twice": "sum"}).first()[0] == 2450
