import random
import re

import numpy as np
from conftest import rows
from threadloom.llm import neardup as nd


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(records, words, least, t, tt):
    sets = []
    for r, text, tags in records:
        w = re.findall(r"[a-z0-9_]+", (text or "").lower())
        if r is None or text is None or len(w) < least:
            continue
        sets.append(
            (r, {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}, {x.strip().lower() for x in (tags or "").split(",") if x.strip()})
        )
    out = set()
    for i, (a, x, ta) in enumerate(sets):
        for b, y, tb in sets[i + 1 :]:
            if a != b and x and y and jaccard(x, y) >= t - 1e-12 and jaccard(ta, tb) >= tt:
                out.add((min(a, b), max(a, b)))
    return sorted(out, key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(8)]
    vocabulary = [f"w{i}" for i in range(400)]
    out, bodies = [], []
    for i in range(n):
        if bodies and rng.random() < 0.6:
            body = list(rng.choice(bodies))
            for _ in range(rng.randrange(0, 5)):
                at = rng.randrange(len(body))
                move = rng.random()
                if move < 0.4:
                    body[at] = rng.choice(vocabulary)
                elif move < 0.7:
                    body.insert(at, rng.choice(vocabulary))
                elif len(body) > 10:
                    body.pop(at)
        else:
            body = rng.choices(common if rng.random() < 0.4 else vocabulary, k=rng.randrange(10, 60))
        bodies.append(body)
        out.append((i, " ".join(body), rng.choice(["a", "a,b", "a,b,c", "", None, "z"])))
    return out


def run(spark, records, **options):
    df = spark.createDataFrame([(r, t, g, "x") for r, t, g in records], "record long, text string, tags string, cid string")
    return rows(nd.record_pairs(*nd.near_duplicates(df, "record", "text", "tags", **options)))


def test_all_pairs_of_random_corpora(spark):
    for seed, words, similarity in ((1, 3, (3, 5)), (2, 5, (4, 5)), (3, 1, (1, 2))):
        records = corpus(seed, 250)
        want = brute(records, words, 10, similarity[0] / similarity[1], 0.5)
        for bounds in ((16, 256), (2, 4), (1, 2)):
            assert run(spark, records, words=words, similarity=similarity, bounds=bounds) == want
        assert want


def test_signatures_meet_for_every_similar_pair():
    rng = random.Random(6)
    for _ in range(400):
        n = rng.randrange(1, 120)
        base = rng.sample(range(1, 10_000), n + 30)
        x = set(base[:n])
        y = set(x)
        for t in rng.sample(sorted(x), rng.randrange(0, n // 3 + 1)):
            y.discard(t)
        y |= set(base[n : n + rng.randrange(0, 10)])
        if not y or jaccard(x, y) < 0.6:
            continue
        df = {t: rng.choice([2, 2, 5, 50, 500]) for t in x | y}
        edges = nd.band_edges(3, 5, 200)
        sig = []
        for s in (x, y):
            order = sorted(s, key=lambda t: (df[t], t))
            sig.append(set(nd.signatures(len(s), 0, np.array(order), np.array([df[t] for t in order]), 3, 5, edges)))
        own = max(int(np.searchsorted(edges, len(s), side="right")) - 1 for s in (x, y))
        assert any(band == own for _, band in sig[0] & sig[1])


def test_copies_nulls_short_and_empty(spark):
    body = " ".join(f"t{i}" for i in range(30))
    records = [
        (1, body, "a"), (2, body, "a"), (3, body.upper(), "A , a"), (4, None, "a"), (None, body, "a"), (5, "too short", "a"), (6, "", None),
        (1, body, "a"), (7, body, "q")
    ]
    assert run(spark, records, words=3) == [(1, 2), (1, 3), (2, 3)]
    assert run(spark, [], words=3) == []
    assert run(spark, [(1, "x " * 50_000, None), (2, "x " * 50_000, "[]")], words=3) == [(1, 2)]


def test_tags_in_json_and_text(spark):
    df = spark.createDataFrame([('["B", " a ", null, ""]',), ("b, A,",), (None,), ("  ",), ("[not json",)], "t string")
    assert [r[0] for r in df.select(nd.tag_set(df.t)).collect()] == [["a", "b"], ["a", "b"], [], [], ["[not json"]]


def test_groups_follow_links(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (10, 11)], "a long, b long")
    members = spark.createDataFrame([(1, 100), (2, 200), (3, 300), (10, 5), (11, 6), (50, 7), (50, 8), (60, 9)], "cid long, record long")
    assert sorted(rows(nd.duplicate_groups(df, members))) == [(5, 5, 1), (6, 5, 1), (7, 7, 0), (8, 7, 0), (100, 100, 1), (200, 100, 2), (300, 100, 1)]
