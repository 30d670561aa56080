"""Entry points that need both packages."""

import __spark_entry__


def test_every_problem_has_its_query():
    names = set(__spark_entry__.queries())
    for n in (1, 2, 3, 4, 5, 6, 7, 10):
        assert f"p{n}_found" in names
    assert any(n.startswith("p8_") for n in names) and any(n.startswith("p9_") for n in names)
    assert set(__spark_entry__.oracle_sql()) <= names


def test_columns_of_the_found_queries(spark, small):
    want = {
        "p1_found": [("field", "string"), ("term", "string"), ("mark", "string")],
        "p2_found": [("root", "string"), ("invocation", "string"), ("start_ms", "bigint"), ("end_ms", "bigint"), ("n_calls", "bigint")],
        "p3_found": [("week", "string"), ("kind", "string"), ("source", "string")],
        "p4_found": [("entity_a", "bigint"), ("entity_b", "bigint")],
        "p5_found": [("linkage", "string"), ("concept_a", "bigint"), ("concept_b", "bigint")],
        "p6_found": [("group_id", "bigint"), ("field", "string"), ("source_id", "bigint")],
        "p7_found": [("tbl", "string"), ("row_id", "bigint"), ("field", "string")],
        "p10_found": [("doc_id", "bigint")],
    }
    queries = __spark_entry__.queries()
    for name, columns in want.items():
        df = queries[name](spark, small)
        assert df.dtypes == columns
        assert df.count() == df.distinct().count()
