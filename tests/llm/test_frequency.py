import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
from conftest import rows
from threadloom.llm import frequency as fr


def brute(texts, pattern=fr.TERM):
    n, records = Counter(), defaultdict(set)
    for record, text in set(texts):
        if record is None or text is None:
            continue
        for t in re.findall(pattern, text):
            n[t.lower()] += 1
            records[t.lower()].add(record)
    return sorted(("f", t, n[t], len(records[t])) for t in n)


def run(spark, texts):
    df = spark.createDataFrame([(r, t, "x") for r, t in texts], "record string, text string, term string")
    return rows(fr.frequencies(fr.text_pairs(df, "f", "text", "record")))


def test_random_texts_against_brute_force(spark):
    rng = random.Random(3)
    words = ["the"] * 60 + [f"word{i}" for i in range(50)] + ["Ab", "ABC", "abc", "_x9", "9abc", "grün"]
    texts = [(str(rng.randrange(300)), " ".join(rng.choices(words, k=rng.randrange(0, 40)))) for _ in range(500)]
    assert run(spark, texts) == brute(texts)


def test_nulls_empty_repeats_and_long_text(spark):
    texts = [(None, "alpha"), ("1", None), ("2", ""), ("3", "alpha alpha"), ("3", "alpha alpha"), ("3", "alpha beta"), ("4", "gamma " * 20_000)]
    assert run(spark, texts) == [("f", "alpha", 3, 1), ("f", "beta", 1, 1), ("f", "gamma", 20_000, 1)]
    assert run(spark, []) == []


def test_runs_across_batches():
    schema = pa.schema([("field", pa.string()), ("term", pa.string()), ("record", pa.string()), ("n", pa.int64())])
    data = [("f", "a", "1", 2), ("f", "a", "1", 1), ("f", "a", "2", 1), ("f", "b", "1", 1), ("g", "b", "1", 4)]
    for cut in range(len(data) + 1):
        batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in part], schema) for part in (data[:cut], [], data[cut:])]
        got = [tuple(r.values()) for b in fr.scan_runs(iter(batches)) for r in b.to_pylist()]
        assert got == [("f", "a", 4, 2), ("f", "b", 1, 1), ("g", "b", 4, 1)]


def test_a_term_of_a_third_of_all_rows(spark):
    texts = [(str(i), "hot " + (f"cold{i}" if i % 3 else "hot")) for i in range(6000)]
    assert run(spark, texts) == brute(texts)


def test_values_and_marks(spark):
    df = spark.createDataFrame([(1, " Ab "), (2, "ab"), (3, "AB"), (4, "  "), (5, None), (6, "c"), (None, "ab"), (1, " Ab ")], "id long, v string")
    counts = fr.frequencies(fr.value_pairs(df, "v", "v", "id"))
    totals = spark.createDataFrame([("v", 4)], "field string, total long")
    assert rows(fr.marked(counts, totals, {"v": 0.75})) == [("v", "ab", 3, 3, "common"), ("v", "c", 1, 1, "rare")]
