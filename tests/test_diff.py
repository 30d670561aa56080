import itertools
import random

import numpy as np
from conftest import rows
from threadloom.operators.assignment import min_cost_assignment
from threadloom.operators.diff import diff_copies, fields_that_differ

SCHEMA = "id long, name string, meta string, at double, extra string"
FIELDS = {"name": "exact", "meta": "json", "at": "epoch"}


def diff(spark, main, copy, **options):
    return rows(diff_copies(spark.createDataFrame(main, SCHEMA), spark.createDataFrame(copy, SCHEMA), "id", FIELDS, **options))


def test_assignment_against_all_permutations():
    rng = random.Random(2)
    for _ in range(60):
        n, m = rng.randrange(1, 5), rng.randrange(1, 6)
        cost = np.array([[rng.randrange(0, 5) for _ in range(m)] for _ in range(n)], dtype=float)
        pairs = min_cost_assignment(cost)
        assert len(pairs) == min(n, m) and len({r for r, _ in pairs}) == len({c for _, c in pairs}) == len(pairs)
        if n <= m:
            best = min(sum(cost[i][p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        else:
            best = min(sum(cost[p[j]][j] for j in range(m)) for p in itertools.permutations(range(n), m))
        assert sum(cost[r][c] for r, c in pairs) == best
    assert min_cost_assignment(np.zeros((0, 3))) == []


def test_fields_missing_and_tolerances(spark):
    main = [(1, "a", '{"x": 1, "y": [1, 2]}', 100.0, "e"), (2, "b", None, 5.0, "e"), (3, "c", "no json", 1.7e12, "e"), (5, None, None, None, "e")]
    copy = [
        (1, "a", '{"y":[1,2],"x":1}', 100.005, "f"), (2, "B", "{}", 5.02, "f"), (3, "c", "no  json", 1.7e9, "f"), (4, "d", None, None, "f"),
        (5, None, None, None, "f")
    ]
    assert diff(spark, main, copy) == [(2, "at", 1), (2, "meta", 1), (2, "name", 1), (3, "meta", 1), (4, "missing_in_main", 1)]


def test_array_order_matters_and_equal_tables_give_nothing(spark):
    assert diff(spark, [(1, "a", "[1, 2]", 1.0, "")], [(1, "a", "[2, 1]", 1.0, "")]) == [(1, "meta", 1)]
    same = [(1, "a", None, 1.0, ""), (None, "z", None, None, "")]
    assert diff(spark, same, same) == []
    assert diff(spark, [], []) == []
    assert diff(spark, same, []) == [(1, "missing_in_copy", 1), (None, "missing_in_copy", 1)]


def test_multiplicity_and_cheapest_pairs(spark):
    main = [(1, "a", "1", 1.0, ""), (1, "a", "1", 1.0, ""), (1, "b", "2", 2.0, ""), (1, "c", "3", 3.0, "")]
    copy = [(1, "a", "1", 1.0, ""), (1, "b", "9", 2.0, ""), (1, "x", "3", 3.0, "")]
    # one of the two equal rows cancels; b and c pair with the rows that differ in one field, the other a is missing
    assert diff(spark, main, copy, once=False) == [(1, "meta", 1), (1, "missing_in_copy", 1), (1, "name", 1)]


def test_only_the_newest_version_counts(spark):
    main = [(1, "old", None, 1.0, ""), (1, "new", None, 2.0, ""), (2, "m", None, 2.0, ""), (2, "m", None, 2.0, "")]
    copy = [(1, "new", None, 2.0, ""), (1, "older", None, 0.5, ""), (2, "n", None, 3000.0, ""), (2, "m", None, 2.0, "")]
    assert diff(spark, main, copy, version="at") == [(2, "at", 1), (2, "name", 1)]


def test_exact_against_brute_force_on_random_keys(spark):
    rng = random.Random(5)
    for turn in range(3):
        one = lambda: (rng.randrange(3), f"n{rng.randrange(3)}", rng.choice([None, "1", "2"]), rng.choice([None, 1.0, 5.0, 9.0]), "")
        main, copy = [one() for _ in range(14)], [one() for _ in range(13)]
        got = diff(spark, main, copy, once=False)
        for k in range(3):
            a, b = [r for r in main if r[0] == k], [r for r in copy if r[0] == k]
            for r in list(a):
                if r in b:
                    a.remove(r), b.remove(r)
            cost = [[sum(x != y for x, y in zip(p[1:4], q[1:4])) for q in b] for p in a]
            if len(a) > len(b):
                cost, n, m = [list(c) for c in zip(*cost)], len(b), len(a)
            else:
                n, m = len(a), len(b)
            best = min((sum(cost[i][p[i]] for i in range(n)) for p in itertools.permutations(range(m), n)), default=0)
            mine = [r for r in got if r[0] == k]
            assert sum(n for _, f, n in mine if not f.startswith("missing")) == best
            assert sum(n for _, f, n in mine if f.startswith("missing")) == m - n


def test_a_key_with_many_rows_is_assigned_exactly(spark):
    """600 and 10 000 rows a side that differ from their partner in one early column only; the order of fingerprints says nothing about partners."""
    for n in (600, 10_000):
        main = [(1, f"n{i}", f"m{i}", float(i), "") for i in range(n)]
        copy = [(1, f"x{i}", f"m{i}", float(i), "") for i in range(n)]
        assert diff(spark, main, copy, once=False) == [(1, "name", n)]


def test_keys_span_batches_and_hold_nulls(spark):
    main = [(k, f"n{i}", None, None, "") for k in (None, 1, 2) for i in range(4000)]
    copy = [(k, f"n{i}", "1", None, "") for k in (None, 1, 2) for i in range(4000 - (k or 0))]
    assert diff(spark, main, copy, once=False) == [
        (1, "meta", 3999), (1, "missing_in_copy", 1), (2, "meta", 3998), (2, "missing_in_copy", 2), (None, "meta", 4000)
    ]


def test_above_the_exact_bound_every_row_is_kept(spark):
    n = 307
    main = [(1, f"m{i}", None, float(i), "") for i in range(n)]
    copy = [(1, f"c{i}", None, float(i), "") for i in range(n - 5)]
    got = dict((f, k) for _, f, k in diff(spark, main, copy, once=False, exact_cells=2500))
    assert got["missing_in_copy"] == 5 and got["name"] == n - 5 and "missing_in_main" not in got


def test_above_the_exact_bound_one_row_more_does_not_shift_pairs(spark):
    n = 250
    main = [(1, f"n{i}", f"m{i}", float(i), "") for i in range(n)]
    copy = [(1, f"n{i}", f"x{i}", float(i), "") for i in range(n)] + [(1, "extra", "e", -5.0, "")]
    assert diff(spark, main, copy, once=False, exact_cells=2500) == [(1, "meta", n), (1, "missing_in_main", 1)]
    two = [(1, f"n{i}", f"x{i}", i + 0.5, "") for i in range(n)]
    assert [r for r in diff(spark, main, two, once=False, exact_cells=2500) if r[1] != "not_certified_minimal"] == [(1, "at", n), (1, "meta", n)]


def test_a_pairing_that_may_be_too_dear_is_reported(spark):
    n = 120
    main = [(1, f"a{i}", f"m{i}", float(i), "") for i in range(n)]
    copy = [(1, f"b{i}", f"x{i}", i + 0.5, "") for i in range(n)]
    # every field differs everywhere: 3 n differences, of which two rounds can vouch for the two fields besides the epoch only
    assert diff(spark, main, copy, once=False, exact_cells=2500) == [(1, "at", n), (1, "meta", n), (1, "name", n), (1, "not_certified_minimal", n)]


def test_a_key_of_any_size_is_assigned_exactly(spark):
    """More than 10^8 pairs of rows: beyond what is held as a matrix, the differences are still the least, and nothing is uncertain."""
    n = 10_050
    main = [(1, f"a{i}", f"m{i}", float(i), "") for i in range(n)]
    copy = [(1, f"b{i}", f"m{i}" if i % 2 else f"x{i}", i + 0.5, "") for i in range(n)]
    assert diff(spark, main, copy, once=False) == [(1, "at", n), (1, "meta", n // 2), (1, "name", n)]


def test_differences_worked_out_by_row_are_assigned_as_a_matrix_is():
    rng = np.random.default_rng(7)
    for n, m in [(40, 40), (30, 50), (50, 30), (1, 3)]:
        side = lambda k: [(rng.integers(0, 4, k), rng.random(k) < 0.1) for _ in range(3)]
        main, copy = side(n), side(m)
        held, worked = (fields_that_differ(main, copy, [False, False, True], cells=cells) for cells in (10**6, 0))
        assert held[0] == worked[0] == min(n, m) and held[1].tolist() == worked[1].tolist()
