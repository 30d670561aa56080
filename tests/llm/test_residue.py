import pytest
from conftest import rows
from threadloom.llm.residue import find_residue, residue_kind

PROSE = "The planner keeps a copy of the cluster for the night. It is rebuilt whenever the index changes, which takes a while.\n"
CASES = {
    "Dear {{ customer }},\n" + PROSE: "placeholder",
    PROSE + "Owner: [TODO: add owner]\n" + PROSE: "placeholder",
    "Context: <<title>>\n" + PROSE: "placeholder",
    PROSE + "Last change: [object Object]": "placeholder",
    "Version %(version)s, maintained by &lt;TEAM_NAME&gt;": "placeholder",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod.\n" + PROSE: "filler",
    "Hier steht ein\nBeispieltext.\n": "filler",
    "404 Not Found\n\nHome\nGo back": "page",
    "<h1>Seite nicht gefunden</h1>\nZur Startseite\nRequest 0a9f33c1": "page",
    "PLEASE ENABLE JAVASCRIPT TO VIEW THIS PAGE.": "page",
    "AccÃ¨s refusÃ©": "page",
    "Error interno del servidor\nVolver": "page",
}
NO_CASES = [
    None, "", "  \n ", PROSE,
    "In templates, write `{{NAME}}`; the value is filled in later.",
    "```md\n# {{title}}\nOwner: [your name]\n```\n" + PROSE,
    "```\nunclosed {{title}}",
    "The old exporter printed {{ Summary }} where the name belonged; fixed and covered by a test.",
    'We changed the wording of the message "Please enable JavaScript to view this page." after feedback.',
    "A 404 from the hub means that the entity was renamed, a 403 that the lease is gone.",
    "Filler such as lorem ipsum is dropped by the check before ranking.",
    "See [the guide](docs/guide.md) and <b>note</b> that __init__ and $PATH are set; use x[i] and {a, b}.",
    "Home is where the index lives. Contact the owner for help.",
]


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    assert residue_kind(text) == CASES[text]


@pytest.mark.parametrize("text", NO_CASES)
def test_no_cases(text):
    assert residue_kind(text) is None


def test_rows_repeats_nulls_and_long_texts(spark):
    data = [
        (1, "404 Not Found"), (1, "404 Not Found"), (2, None), (None, "Access denied"), (3, PROSE * 5000 + "Dear {{ name }},"),
        (4, "not found " + PROSE * 2000)
    ]
    df = spark.createDataFrame([(*d, "x") for d in data], "doc long, text string, kind string")
    assert rows(find_residue(df, "doc", "text")) == [(1, "page"), (1, "page"), (3, "placeholder"), (None, "page")]
    assert rows(find_residue(df.limit(0), "doc", "text")) == []


def test_long_runs_of_one_character_take_no_time():
    import time

    began = time.perf_counter()
    for c in "_-*{[<$%@#. \"":
        assert residue_kind("Not found\n" + c * 200_000 + "x\n" + PROSE * 50) is None
    assert time.perf_counter() - began < 20


def test_words_about_placeholders_count_within_their_sentence_only():
    assert residue_kind("Dear {{ name }}, welcome aboard. The message came in late.") == "placeholder"
    assert residue_kind("It was late. The old exporter printed {{ name }} there. We fixed it.") is None
    assert residue_kind("The old exporter printed {{ name }} there. Dear {{ name }}, welcome aboard.") == "placeholder"
