import random

import numpy as np
from conftest import rows
from threadloom.llm import overlap as ov


def test_runs_round_trip():
    rng = np.random.default_rng(7)
    for n in (0, 1, 2, 100, 5000, ov.RANGE):
        ids = np.sort(rng.choice(ov.RANGE, n, replace=False))
        assert (ov.decode_run(ov.encode_run(ids)) == ids).all()


def test_gallop_and_merge_count_the_same():
    rng = np.random.default_rng(8)
    for n, m in ((1, 1), (1, 9000), (5, 60_000), (300, 400), (7, 7)):
        for _ in range(20):
            a, b = np.sort(rng.choice(65_536, n, replace=False)), np.sort(rng.choice(65_536, m, replace=False))
            want = len(np.intersect1d(a, b))
            assert ov.gallop(a, b) == ov.merge(a, b) == ov.intersect_count(a, b) == ov.intersect_count(b, a, 1) == want
    assert ov.intersect_count(np.array([], dtype=np.int64), np.array([1])) == 0


def brute(data, least, t):
    sets = {}
    for g, s, i in data:
        if None not in (g, s, i):
            sets.setdefault((g, s), set()).add(i)
    keys = sorted(k for k, v in sets.items() if len(v) >= least)
    out = []
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if a[0] == b[0] and shared and shared >= t * len(sets[a] | sets[b]) - 1e-9:
                out.append((a[0], a[1], b[1], len(sets[a]), len(sets[b]), shared))
    return sorted(out, key=repr)


def run(spark, data, least, num, den):
    df = spark.createDataFrame([(g, s, i, "x") for g, s, i in data], "grp string, sid long, id long, n string")
    return rows(ov.overlaps(df, least, num, den).select("grp", "a", "b", "na", "nb", "shared"))


def test_random_sets_against_brute_force(spark):
    rng = random.Random(9)
    data = []
    pool = [rng.randrange(0, 400_000) for _ in range(500)]
    bases = [rng.sample(pool, 60) for _ in range(12)]
    for g in "pq":
        for s in range(60):
            ids = set(rng.sample(bases[s % 12], rng.randrange(5, 60))) | set(rng.sample(pool, rng.randrange(0, 20))) | {42}
            data += [(g, s, i) for i in ids]
    data += [(None, 1, 1), ("p", None, 2), ("p", 3, None)] + data[:50]
    rng.shuffle(data)
    for num, den in ((2, 5), (1, 10), (4, 5)):
        want = brute(data, 20, num / den)
        assert run(spark, data, 20, num, den) == want
        assert want or num == 4


def test_empty_and_one_very_large_set(spark):
    assert run(spark, [], 1, 2, 5) == []
    data = [("g", 1, i) for i in range(70_000)] + [("g", 2, i) for i in range(0, 70_000, 2)] + [("g", 3, 5)]
    assert run(spark, data, 1, 2, 5) == [("g", 1, 2, 70_000, 35_000, 35_000)]


def test_every_pair_that_shares_an_identifier(spark):
    data = [("g", 1, i) for i in range(400)] + [("g", 2, 7), ("g", 3, 7), ("g", 3, 900), ("g", 4, 901), ("h", 5, 7)]
    assert run(spark, data, 1, 0, 1) == brute(data, 1, 0) == [("g", 1, 2, 400, 1, 1), ("g", 1, 3, 400, 2, 1), ("g", 2, 3, 1, 2, 1)]


def test_p5_shared_has_small_sets_and_dissimilar_pairs(spark):
    from threadloom.llm.queries import QUERIES

    found = QUERIES["p5_shared"](spark, "/root/testdata/sf0.01").collect()
    assert {
        (r.linkage, r.concept_a, r.concept_b, r.shared) for r in QUERIES["p5_overlap"](spark, "/root/testdata/sf0.01").collect()
    } < {(r.linkage, r.concept_a, r.concept_b, r.shared) for r in found}
    assert any(min(r.size_a, r.size_b) < 20 for r in found) and any(r.shared * 10 < r.size_a + r.size_b - r.shared for r in found)
