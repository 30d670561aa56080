import pytest
from pyspark.sql import functions as F
from threadloom.functions import clean, names, text


def one(spark, col, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(col(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "name, want",
    [
        ("JSONParser", "json_parser"), ("some-words", "some_words"), ("parse42Things", "parse_42_things"), ("HTTP_REQUEST", "http_request"),
        ("plain", "plain"), ("  ", ""), ("", ""), ("ünî", "n")
    ]
)
def test_canonical(spark, name, want):
    assert one(spark, names.canonicalize, name) == want
    assert names.canonicalize_text(name) == want


def test_variants(spark):
    assert one(spark, names.variants, "parseHTML") == ["parseHTML", "parse_html", "parse-html", "parse html"]
    assert one(spark, names.variants, "ABC") == ["ABC", "abc"]


@pytest.mark.parametrize(
    "query, want",
    [("How does the Parser parse the parser", ["Parser", "parse"]), ("the", ["the"]), ("the of", ["the", "of"]), ("x yy", ["yy"]), ("", [])]
)
def test_search_terms(spark, query, want):
    assert one(spark, names.content_terms, query) == want
    assert names.content_terms_text(query) == want


@pytest.mark.parametrize(
    "word, want",
    [
        ("processes", "process"), ("process", "process"), ("status", "status"), ("loading", "load"), ("queries", "query"), ("is", "is"),
        ("des", "des"), ("seemingly", "seem")
    ]
)
def test_stem(spark, word, want):
    assert one(spark, text.stem, word) == want


@pytest.mark.parametrize(
    "t, want", [("30s", 30.0), ("15m", 900.0), ("2h", 7200.0), ("7d", 604800.0), ("2w", 1209600.0), ("12", 12.0), ("x", None), (None, None)]
)
def test_durations(spark, t, want):
    assert one(spark, names.duration_seconds, t) == want


@pytest.mark.parametrize(
    "t, want",
    [
        ("1970-01-01T00:00:01", 1000), ("1970-01-01 00:00:01.250", 1250), ("1970-01-01T01:00:00+01:00", 0), ("1970-01-01T00:00:00Z", 0),
        ("1969-12-31T16:00:00-08:00", 0), ("12", 12000), ("0000-00-00T00:00:00", None),
        ("pending", None), ("", None), (None, None), ("2026", 2026000), (" 2026-01-01T00:00:00", None), ("2026-01-01", None), ("9" * 25, None),
    ],
)
def test_times(spark, t, want):
    assert one(spark, clean.time_ms, t) == want


def test_weeks_start_on_monday(spark):
    ms = lambda day: day * 86_400_000 + 5
    assert [one(spark, clean.week_of, ms(d), "long") for d in (0, 3, 4, 10, 11, -4)] == [
        "1969-12-29", "1969-12-29", "1970-01-05", "1970-01-05", "1970-01-12", "1969-12-22"
    ]


def test_word_pairs_break_at_stop_words_and_clauses(spark):
    df = spark.createDataFrame([(1, "Loads sentence models, the sentence model. alpha and beta alpha alpha"), (2, None), (3, "")], "id int, t string")
    got = {(r.id, r.pair): r.n for r in text.word_pairs(df, "id", "t").collect()}
    assert got == {(1, "load_sentence"): 1, (1, "load_model"): 1, (1, "model_sentence"): 2, (1, "alpha_beta"): 2}


def test_snippets():
    assert text.query_words("Tap tap a of tank") == ["tank", "tap", "of"]
    assert text.kwic("one two three four five", ["three"], 15) == "…two «three» four…"
    assert text.kwic("one two three four five", ["three"], 200) == "one two «three» four five"
    assert text.kwic("The TapValve is\n\n open", ["tap"], 40) == "The «Tap»Valve is open"
    assert text.kwic("nothing relevant", ["tap"]) == text.kwic(None, ["x"]) == text.kwic("x", []) == ""
    assert text.kwic("a lens then a mirror", ["mirror", "lens"], 14) == "a «lens» then…"
    assert text.kwic_line("a\n  the Word here\nb", ["word"]) == ("the «Word» here", 1)
    assert text.kwic_line("a\n\n  the Word here\nb\n\nc", ["word"], around=2) == ("a\n\n  the «Word» here\nb", 2)
    assert text.kwic_line("nothing", ["word"]) is None


CODE = "import os\nTANK_SIZE = 9  # default tank\n\ndef tank_level(x):\n    return x\n\nprint(tank_level(4))\n"


def test_definition_lines():
    assert text.definition_line(CODE, ["tank"], "tank_level") == ("def «tank»_level(x):", 3)
    assert text.definition_line(CODE, ["mirror"], "tank_level", around=1) == ("def «tank_level»(x):\n    return x", 3)
    assert text.definition_line(CODE, ["tank"], "TANK_SIZE") == ("«TANK»_SIZE = 9  # default tank", 1)
    assert text.definition_line(
        CODE, ["tank"], "absent"
    ) is None and text.definition_line("", ["x"], "x") is None and text.definition_line(CODE, ["x"], None) is None


def bound(t):
    return [(p.word, p.antecedent) for p in text.pronouns(t) if p.antecedent]


def test_pronouns():
    assert bound(
        "We met Alice Smith in town. She left early. The crown matters. We saw the crown. It was lost."
    ) == [("She", "Smith"), ("It", "crown")]
    assert bound("Nora came. " + "Nothing here. " * 5 + "She left.") == []
    assert bound("Tomorrow all ends. He was told.") == [] and bound("I'm late. He knows.") == []
    alone, two = text.pronouns("Nora spoke. She sat.")[0], text.pronouns("Nora saw Vera. She sat.")[0]
    assert (alone.confidence, two.confidence, alone.offset) == (0.5, 0.25, 12)
    t = "Nora came. She sat. She spoke."
    assert text.resolved(t, text.pronouns(t)) == "Nora came. Nora sat. Nora spoke."
    assert text.resolved("something else", text.pronouns(t)) == "something else"
    opening = lambda x: text.unresolved_opening(text.pronouns(x))
    assert opening("He went back. Then we left.") == [(0, "He")] and opening("Nora went. She sat.") == []
    assert text.dominant_person(t, text.pronouns(t)) == "Nora" and text.dominant_person(
        "Vera rang. Vera waited.", []
    ) == "Vera" and text.dominant_person("Vera rang.", []) is None


def test_functions_for_sql(spark):
    text.udfs(spark)
    row = spark.sql("SELECT kwic('one two three', 'two') AS k, resolve_pronouns('Nora came. She sat.') AS r, kwic(null, 'x') AS n").first()
    assert (row.k, row.r, row.n) == ("one «two» three", "Nora came. Nora sat.", "")


@pytest.mark.parametrize(
    "token, want",
    [
        ("MCP", 1.0), ("Query", 1.0), ("first", 0.0), ("KeyError", 1.0), ("scan_prompt", 1.0), ("a.b::c", 1.0), ("ns/some-long-name1", 2.0),
        ("x" * 12, 0.5), ("A", 0.0)
    ]
)
def test_shapes(spark, token, want):
    assert one(spark, names.shape_score, token) == want


def test_slug_hash_globs_channels(spark):
    assert one(spark, names.slug, " Hello, World! ") == "hello_world" and one(spark, names.slug, "!!!") == "subject"
    import hashlib

    assert spark.range(1).select(names.member_hash(F.array(F.lit("b"), F.lit("a")))).first()[0] == hashlib.sha256(b"a\nb").hexdigest()[:8]
    import re

    assert re.match(
        names.glob_pattern("session/*"), "session/x"
    ) and not re.match(names.glob_pattern("a?c"), "abbc") and re.match(names.glob_pattern("[!x]b"), "ab")
    df = spark.createDataFrame([("global:alerts",), ("global",), ("x",)], "c string")
    hits = lambda p: [r[0] for r in df.filter(names.channel_matches(F.col("c"), p)).collect()]
    assert hits("global:") == ["global:alerts"] and hits("*") == hits("") and hits("glob*") == ["global:alerts", "global"] and hits("x") == ["x"]
