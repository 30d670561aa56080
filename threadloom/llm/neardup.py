"""Near-duplicate records with small edits: an exact set-similarity join by token-combination prefixes.

A record is its set of word sequences ("tokens"). Tokens are ordered from rare to frequent and put into classes by
frequency: class 1 is indexed by single tokens, class k by combinations of k tokens, because a frequent token says
little alone. If two sets of Jaccard similarity t or more are both cut after a long enough prefix, then the set whose
prefix ends first lacks at most ``slack = n - ceil(t * n)`` of its tokens in the other. A class with p prefix tokens
survives as long as k of them are shared, so prefixes are extended until the sum of ``p - (k - 1)`` over the classes
exceeds slack: then some class shares k tokens, and both records index that combination. No pair is lost.

To keep the number of combinations small, classes 2 and 3 are divided further by a hash of the token, each
part counting as a class of its own. The number of parts depends on a band of set sizes; a record is indexed for
its own band and the next larger one, so that all partners it can have share a band with it.

Scale: tokens that only one record has (most of them, as a rule) fill up prefixes without being indexed. Identical
records are one class from the start and take part once. Candidates are verified exactly on the whole sets. All joins
are equi-joins on tokens, combinations or class ids; hot keys are split by the adaptive skew join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.clean import strip
from threadloom.staging import stage

#: Largest document frequency of class 1 and of class 2; what is more frequent is class 3.
CLASS_BOUNDS = (16, 256)
WORD = r"[a-z0-9_]+"
#: 64-bit words of a set's bitmap.
LANES = 4


def word_sequences(text: Column, words: int, pattern: str = WORD) -> Column:
    """Distinct hashes of the sequences of ``words`` words of a text in lower case; empty for shorter texts."""
    found = F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))
    return sequences_of(found, words)


def sequences_of(found: Column, words: int) -> Column:
    at = lambda i, k: F.get(found, i + F.lit(k))
    hashed = F.transform(found, lambda w, i: F.when(at(i, words - 1).isNotNull(), F.xxhash64(w, *[at(i, k) for k in range(1, words)])))
    return F.array_sort(F.array_distinct(F.array_compact(hashed)))


def tag_set(tags: Column) -> Column:
    """Sorted distinct tags of a JSON array, or of the parts between commas where the text isn't one; never null."""
    parsed = F.from_json(tags, "array<string>")
    parts = F.coalesce(F.when(tags.rlike(r"^\s*\["), parsed), F.split(F.coalesce(tags, F.lit("")), ","))
    clean = F.transform(parts, lambda x: F.lower(strip(x)))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda x: x.isNotNull() & (x != ""))))


def band_edges(num: int, den: int, largest: int) -> list[int]:
    """Lower ends of size bands, each ``den / num`` times the one before: sizes with a ratio above num/den are at most one band apart."""
    edges = [1]
    while edges[-1] <= largest:
        edges.append(max(edges[-1] + 1, -(-edges[-1] * den // num)))
    return edges


def parts_for(smallest: int, num: int, den: int) -> tuple[int, int]:
    """Parts of class 2 and of class 3 that sets of ``smallest`` or more tokens can afford; (0, 0) means singles only."""
    spare = -(-smallest * num // den) - 1  # class parts may cost this many tokens and still leave the prefix within the set
    two, three = spare // 3, spare // 3
    return (max(1, two), max(1, three)) if spare >= 3 else (0, 0)


def signatures(
    n: int, alone: int, tokens: np.ndarray, df: np.ndarray, num: int, den: int, edges: list[int], bounds: tuple[int, int] = CLASS_BOUNDS
) -> list[tuple[int, int]]:
    """(signature, band) of one set: n tokens, ``alone`` of them in no other set, the others by rising frequency."""
    slack = n - -(-n * num // den)
    if alone > slack:
        return []
    own = int(np.searchsorted(edges, n, side="right")) - 1
    token_list = tokens.tolist()
    out = []
    for band in (own, own + 1):
        two, three = parts_for(edges[max(band - 1, 0)], num, den)
        if two:
            level = 1 + (df > bounds[0]) + (df > bounds[1])
        else:
            level = np.ones(len(df), dtype=np.int64)
        part = np.where(level == 1, 0, np.where(level == 2, tokens % max(two, 1), tokens % max(three, 1))).tolist()
        seen: dict[tuple[int, int], list[int]] = {}
        units = alone
        for token, k, p in zip(token_list, level.tolist(), part):
            group = seen.setdefault((k, p), [])
            group.append(token)
            units += len(group) >= k
            if units > slack:
                break
        for (k, p), group in seen.items():
            for combination in combinations(sorted(group), k):
                out.append((hash((band, k, *combination)), band))
    return out


def index_sets(sets: DataFrame, num: int, den: int, bounds: tuple[int, int] = CLASS_BOUNDS) -> DataFrame:
    """(sig, band, cid, n, own) rows of (cid, n, tokens): the signatures of every set."""
    exploded = sets.select("cid", F.explode("tokens").alias("token"))
    shared = exploded.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    per_set = exploded.join(shared, "token").groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
    rows = sets.select("cid", "n").join(per_set, "cid").select("cid", "n", F.col("t.df").alias("df"), F.col("t.token").alias("token"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            edges = band_edges(num, den, int(frame["n"].max()) if len(frame) else 1)
            cids, ns, sigs, bands, owns = [], [], [], [], []
            for cid, n, df, token in zip(frame["cid"], frame["n"], frame["df"], frame["token"]):
                found = signatures(n, n - len(token), token, df, num, den, edges, bounds)
                own = int(np.searchsorted(edges, n, side="right")) - 1
                cids += [cid] * len(found)
                ns += [n] * len(found)
                owns += [own] * len(found)
                sigs += [s for s, _ in found]
                bands += [b for _, b in found]
            yield pd.DataFrame({"sig": sigs, "band": bands, "cid": cids, "n": ns, "own": owns}).astype(
                {"sig": "int64", "band": "int32", "cid": "int64", "n": "int32", "own": "int32"}
            )

    return rows.mapInPandas(run, "sig long, band int, cid long, n int, own int")


def bitmap(tokens: str, lanes: int = LANES) -> list[Column]:
    """A set as ``lanes`` * 64 parity bits: two sets differ in at least as many tokens as their bitmaps differ in bits."""
    lane = "aggregate({t}, 0L, (acc, x) -> IF(pmod(shiftrightunsigned(x, 6), {n}L) = {k}L, acc ^ shiftleft(1L, CAST(x & 63L AS INT)), acc))"
    return [F.expr(lane.format(t=tokens, n=lanes, k=k)).alias(f"bits{k}") for k in range(lanes)]


def similar_sets(
    sets: DataFrame, num: int, den: int, bounds: tuple[int, int] = CLASS_BOUNDS, also: tuple[str, Callable[[Column, Column], Column]] | None = None
) -> DataFrame:
    """(a, b, shared): every pair a < b of (cid, n, tokens) sets with Jaccard similarity of num/den or more. ``sets`` should be staged.

    ``also`` names a column and a condition on its values in both sets. It and a bound from small bitmaps are looked at before the sets themselves
    move.
    """
    index = index_sets(sets, num, den, bounds)
    a, b = (index.select("sig", "band", *[F.col(c).alias(f"{c}_{s}") for c in ("cid", "n", "own")]) for s in "ab")
    # The band of a signature is that of the larger partner.
    fits = (F.col("cid_a") < F.col("cid_b")) & (F.greatest("own_a", "own_b") == F.col("band")) & (
        F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num
    )
    pairs = a.join(b, ["sig", "band"]).filter(fits).select(F.col("cid_a").alias("a"), F.col("cid_b").alias("b")).distinct()
    small = sets.select("cid", "n", *bitmap("tokens"), *([F.col(also[0]).alias("extra")] if also else []))
    side = lambda s: small.select(F.col("cid").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in small.columns[1:]])
    near = pairs.join(side("a"), "a").join(side("b"), "b")
    differ = sum((F.bit_count(F.col(f"bits{k}_a").bitwiseXOR(F.col(f"bits{k}_b"))) for k in range(LANES)), F.lit(0))
    total = F.col("n_a") + F.col("n_b")
    near = near.filter((total - differ) * (num + den) >= total * (2 * num))
    if also:
        near = near.filter(also[1](F.col("extra_a"), F.col("extra_b")))
    left = sets.select(F.col("cid").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("cid").alias("b"), F.col("tokens").alias("tb"))
    both = near.select("a", "b").join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("ta", "tb"))
    union = F.size("ta") + F.size("tb") - shared
    return both.filter(shared * den >= union * num).select("a", "b", shared.alias("shared"))


def text_classes(df: DataFrame, record: str, text: str, tags: str, words: int, least_words: int) -> tuple[DataFrame, DataFrame]:
    """Classes (cid, n, tokens, tags) of records with the same tokens and tags, and members (cid, record)."""
    rows = df.select(
        F.col(f"`{record}`").alias("record"), F.col(f"`{text}`").alias("text"), F.col(f"`{tags}`").alias("tags")
    ).filter("record IS NOT NULL AND text IS NOT NULL")
    words_of = rows.repartition("record").distinct().select("record", "tags", F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)).alias("w"))
    # No filter before the table is staged: it would be pushed down, and the words found again for every sequence.
    rows = words_of.select(
        "record", tag_set(F.col("tags")).alias("tags"), F.when(F.size("w") >= least_words, sequences_of(F.col("w"), words)).alias("tokens")
    )
    rows = rows.withColumn("cid", F.xxhash64("tokens", "tags"))
    rows = stage(rows, "near-rows").filter(F.size("tokens") > 0)
    members = rows.select("cid", "record")
    keep = rows.groupBy("cid").agg(F.min("record").alias("record"))
    classes = rows.join(keep, ["cid", "record"]).dropDuplicates(["cid"]).select("cid", F.size("tokens").alias("n"), "tokens", "tags")
    return classes, members


def near_duplicates(
    df: DataFrame, record: str, text: str, tags: str, words: int = 5, least_words: int = 10, similarity: tuple[int, int] = (4, 5),
    tag_similarity: tuple[int, int] = (1, 2), bounds: tuple[int, int] = CLASS_BOUNDS
) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between classes of records that are largely the same text under largely the same tags, and members (cid, record).

    Similarities are fractions: Jaccard of the sets of word sequences, and of the tag sets, where two empty sets have
    similarity 1. Null records, null texts and texts with fewer than ``least_words`` words (or too few for one sequence) are left out;
    null or blank tags mean no tags. Records with equal token and tag sets share a class: members says which. Rows repeated verbatim
    count once; a record with several different texts is a member of several classes. Other columns are ignored.
    """
    classes, members = text_classes(df, record, text, tags, words, least_words)
    classes = stage(classes, "near-classes")
    num, den = tag_similarity

    def alike(x: Column, y: Column) -> Column:
        shared = F.size(F.array_intersect(x, y))
        return shared * den >= (F.size(x) + F.size(y) - shared) * num

    return similar_sets(classes, *similarity, bounds, ("tags", alike)).select("a", "b"), members


def record_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """(entity_a, entity_b) of all linked records, and of all records within a class, the smaller first."""
    m = lambda side: members.select(F.col("cid").alias(side), F.col("record").alias(f"r{side}"))
    across = links.join(m("a"), "a").join(m("b"), "b").filter("ra != rb")
    within = m("a").join(m("a").withColumnRenamed("ra", "rb"), "a").filter("ra < rb")
    pairs = across.select("ra", "rb").unionByName(within.select("ra", "rb"))
    return pairs.select(F.least("ra", "rb").alias("entity_a"), F.greatest("ra", "rb").alias("entity_b")).distinct()


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(cid, root) of every linked class: the smallest class id reachable. Labels hop along links and along roots; staged each round."""
    edges = stage(links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a")), "edges")
    labels = stage(edges.groupBy(F.col("x").alias("cid")).agg(F.least(F.min("y"), F.col("x")).alias("root")), "labels")
    for _ in range(rounds):
        near = edges.join(labels.select(F.col("cid").alias("y"), "root"), "y").groupBy(F.col("x").alias("cid")).agg(F.min("root").alias("near"))
        jump = labels.select(F.col("cid").alias("root"), F.col("root").alias("far"))
        new = labels.join(near, "cid", "left").join(jump, "root", "left").select(
            "cid", F.least("root", "near", "far").alias("root"), F.col("root").alias("old")
        )
        new = stage(new, "labels")
        changed = new.filter("root != old").limit(1).count()
        labels = new.select("cid", "root")
        if not changed:
            break
    else:
        raise RuntimeError(f"labels still change after {rounds} rounds")
    return labels


def duplicate_groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """(record, group_id, n_links): one row for each record with a copy; group_id is the smallest record of the group, n_links the linked classes."""
    roots = components(links)
    degree = links.select(F.col("a").alias("cid")).unionAll(links.select("b")).groupBy("cid").agg(F.count(F.lit(1)).alias("n_links"))
    size = members.groupBy("cid").agg(F.countDistinct("record").alias("size"))
    rows = members.join(roots, "cid", "left").join(degree, "cid", "left").join(size, "cid").filter("root IS NOT NULL OR size > 1")
    rows = rows.withColumn("root", F.coalesce("root", "cid"))
    smallest = rows.groupBy("root").agg(F.min("record").alias("group_id"))
    return rows.join(smallest, "root").groupBy("record").agg(
        F.min("group_id").alias("group_id"), F.sum(F.coalesce("n_links", F.lit(0))).alias("n_links")
    )
