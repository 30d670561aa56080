"""Aggregations, windows and filters of the store: statistics, facets, telemetry, channels, sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions.frames import plain_strings
from threadloom.functions.names import channel_matches, glob_pattern, namespace
from threadloom.operators.prefix_sum import running_totals
from threadloom.staging import stage

# --- percentiles by nearest rank, as small reports need them -------------------------------------


def nearest_rank(df: DataFrame, groups: Sequence[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """(groups, one column per percentile): the value at index min(n - 1, int(p * n)) of the sorted values of a group, nulls left out.

    Values are counted first, so that a window holds the distinct values of a group.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    w = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(1))
    rows = counts.withColumn(
        "upto", F.sum("c").over(w.orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow))
    ).withColumn("n", F.sum("c").over(w))
    at = lambda p: F.least(F.col("n") - 1, F.floor(F.lit(p) * F.col("n")))
    hit = lambda p: (F.col("upto") > at(p)) & (F.col("upto") - F.col("c") <= at(p))
    return rows.groupBy(*groups).agg(*[F.max(F.when(hit(p), F.col("v"))).alias(c) for c, p in wanted.items()])


# --- store statistics ------------------------------------------------------------------------


def store_stats(entities: DataFrame, links: DataFrame) -> DataFrame:
    """(what, name, n, concepts): entities by kind, links and distinct concepts by linkage."""
    kinds = entities.groupBy(F.col("kind").alias("name")).agg(
        F.count(F.lit(1)).alias("n"), F.lit(None).cast("long").alias("concepts")
    ).withColumn("what", F.lit("kind"))
    verbs = links.groupBy(F.col("linkage").alias("name")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("concept_id").alias("concepts")
    ).withColumn("what", F.lit("linkage"))
    return kinds.unionByName(verbs).select("what", "name", "n", "concepts")


def code_fraction(entities: DataFrame) -> DataFrame:
    """(code_fraction): share of entities other than concepts that are code; 1.0 for an empty store."""
    return entities.filter("kind != 'concept'").agg(
        F.coalesce(F.avg(F.when(F.col("kind") == "code", 1.0).otherwise(0.0)), F.lit(1.0)).alias("code_fraction")
    )


def concept_density(links: DataFrame) -> DataFrame:
    """(concept_id, total, per_linkage): links of each concept, in all and as sorted (linkage, n) entries."""
    counts = links.groupBy("concept_id", "linkage").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("concept_id").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("linkage", "n"))).alias("per_linkage"))


def facets(memories: DataFrame) -> DataFrame:
    """(facet, value, n): memories by type and by tag."""
    tags = F.filter(F.from_json("tags", "array<string>"), lambda t: t.isNotNull() & (t != ""))
    types = memories.select(F.lit("mtype").alias("facet"), F.col("mtype").alias("value"))
    tagged = memories.select(F.lit("tag").alias("facet"), F.explode(tags).alias("value"))
    return types.unionByName(tagged).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def noise_marks(entities: DataFrame, links: DataFrame, least: int = 2, most_share: float = 0.25, namespaces: Sequence[str] = ()) -> DataFrame:
    """(concept_id, df, noise): concepts whose number of entities is below ``least`` or above max(least, int(share * N)) become noise; protected
    ones don't.

    N counts the entities that aren't concepts. Concepts back within the bounds lose the mark. ``namespaces`` restricts the concepts that are
    looked at.
    """
    n = entities.filter("kind != 'concept'").agg(
        F.greatest(F.lit(least), F.floor(F.count(F.lit(1)) * F.lit(most_share))).alias("most")
    ).withColumn("one", F.lit(1))
    concepts = entities.filter("kind = 'concept'").select(
        F.col("id").alias("concept_id"), "name", F.coalesce("protected", F.lit(0)).alias("protected")
    )
    if namespaces:
        concepts = concepts.filter(namespace(F.col("name")).isin(list(namespaces)))
    df = links.groupBy("concept_id").agg(F.countDistinct("entity_id").alias("df"))
    rows = concepts.join(df, "concept_id", "left").withColumn(
        "df", F.coalesce("df", F.lit(0))
    ).withColumn("one", F.lit(1)).join(F.broadcast(n), "one")
    outside = (F.col("df") < least) | (F.col("df") > F.col("most"))
    return rows.select("concept_id", "df", F.when(outside & (F.col("protected") == 0), 1).otherwise(0).alias("noise"))


def same_as_audit(links: DataFrame) -> DataFrame:
    """(variants, canonicals): how many canonical concepts have how many variants."""
    per = links.filter("linkage = 'same-as'").groupBy("concept_id").agg(F.countDistinct("entity_id").alias("variants"))
    return per.groupBy("variants").agg(F.count(F.lit(1)).alias("canonicals"))


def structural_counts(entities: DataFrame, links: DataFrame, memories: DataFrame) -> DataFrame:
    """(counter, n): the counters that a derivation run is stamped with."""
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("counter"), "n")
    parts = [one(k, entities.filter(F.col("kind") == k)) for k in ("doc", "code", "concept", "memory")]
    parts += [
        one("links", links), one("memories", memories), one("protected", entities.filter("protected = 1")),
        one("noise", entities.filter("noise = 1")), one("with_canonical", entities.filter("canonical_name IS NOT NULL"))
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def partition_audit(entities: DataFrame, links: DataFrame, partitions: DataFrame) -> DataFrame:
    """(partition_id, entities, concepts, links, orphans): figures of each partition; orphans are entities whose partition is unknown."""
    own = entities.groupBy("partition_id").agg(
        F.count(F.lit(1)).alias("entities"), F.sum(F.when(F.col("kind") == "concept", 1).otherwise(0)).alias("concepts")
    )
    bits = links.join(
        entities.select(F.col("id").alias("entity_id"), "partition_id"), "entity_id"
    ).groupBy("partition_id").agg(F.count(F.lit(1)).alias("links"))
    known = partitions.select(F.col("id").alias("partition_id"), F.lit(1).alias("known"))
    rows = own.join(bits, "partition_id", "left").join(known, "partition_id", "full")
    return rows.select(
        "partition_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("entities", "concepts", "links")],
        F.when(F.col("known").isNull(), F.col("entities")).otherwise(0).alias("orphans")
    )


# --- reinforcement -------------------------------------------------------------------------------


def reinforcement(links: DataFrame, entities: DataFrame, now: float, halflife_days: float = 30.0, cap: float = 5.0) -> DataFrame:
    """(concept_id, signal): sum of +-|weight| * 2^(-age / halflife) over reinforcing and contradicting links, within +-cap.

    The sign follows the verb; a null weight is 1; a half-life of 0 or less means no decay; an unknown age is 0.
    """
    rows = links.filter(F.col("linkage").isin("reinforces", "contradicts")).join(
        entities.select(F.col("id").alias("entity_id"), "created_at"), "entity_id"
    )
    sign = F.when(F.col("linkage") == "reinforces", 1.0).otherwise(-1.0) * F.abs(F.coalesce("weight", F.lit(1.0)))
    age = F.greatest(F.lit(0.0), F.lit(now) - F.coalesce("created_at", F.lit(now))) / 86400.0
    decay = F.pow(F.lit(2.0), -age / halflife_days) if halflife_days > 0 else F.lit(1.0)
    total = rows.groupBy("concept_id").agg(F.sum(sign * decay).alias("signal"))
    return total.withColumn("signal", F.greatest(F.lit(-cap), F.least(F.lit(cap), F.col("signal")))) if cap > 0 else total


def rescored(scored: DataFrame, doc_concepts: DataFrame, signals: DataFrame, alpha: float, cap: float = 5.0) -> DataFrame:
    """(entity_id, score): scores times 1 + alpha * tanh(sum of the document's signals / cap)."""
    per_doc = doc_concepts.join(signals, "concept_id").groupBy("entity_id").agg(F.sum("signal").alias("s"))
    factor = 1.0 + alpha * F.tanh(F.coalesce("s", F.lit(0.0)) / (cap if cap > 0 else 1.0))
    return scored.join(per_doc, "entity_id", "left").select("entity_id", (F.col("score") * factor).alias("score"))


# --- telemetry ---------------------------------------------------------------------------------------


def telemetry_summary(log: DataFrame, dimension: str) -> DataFrame:
    """(key, n, zero, p50, p95, p99): calls, calls without a result and nearest-rank latencies of each value of a dimension."""
    rows = log.withColumn("key", F.col(dimension))
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("cardinality") == 0, 1).otherwise(0)).alias("zero"))
    return counts.join(nearest_rank(rows, ["key"], "latency_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99}), "key", "left")


def top_queries(log: DataFrame, zero_only: bool = False, k: int = 20) -> DataFrame:
    """(body, n): the most frequent query texts, or the most frequent ones without a result."""
    rows = log.filter("cardinality = 0") if zero_only else log
    return rows.filter(F.col("body").isNotNull()).groupBy("body").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "body").limit(k)


# Commands that turn an index into answers.
ANSWERS = ("context", "memory", "concept", "where", "query")
SEVERITY = {"high": 0, "medium": 1, "low": 2}


def adoption(log: DataFrame, by: Sequence[str], facts: DataFrame | None = None, commands: Sequence[str] = ANSWERS) -> DataFrame:
    """(by, kind, severity, detail): what keeps each store from being used well, as its log and the facts about it say.

    ``log`` has ``by``, kind, invocation, command and cardinality: no call from hooks (``no_hooks``); 30 % or more, and five or more, of the
    lookups other than scans without a
    result (``high_zero_result``); in twenty calls or more some of ``commands`` never used (``underused_reads``). ``facts`` has ``by``, entities,
    stale_files, running and
    supervised, each of which may be null: nothing ingested, ten stale files or more, not running, not supervised.
    """
    lookup = F.coalesce(F.col("kind") != "scan", F.lit(True))
    counts = log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.sum(F.when(F.col("invocation") == "hook", 1).otherwise(0)).alias("hooks"),
        F.sum(F.when(lookup, 1).otherwise(0)).alias("lookups"),
        F.sum(F.when(lookup & (F.col("cardinality") == 0), 1).otherwise(0)).alias("zero"),
        *[F.max(F.when(F.col("command") == c, 1).otherwise(0)).alias(f"_c{i}") for i, c in enumerate(commands)],
    )
    rows = counts
    if facts is not None:
        rows = counts.join(facts.select(*by, "entities", "stale_files", "running", "supervised"), list(by), "full")
    unused = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"_c{i}") == 0, F.lit(c)) for i, c in enumerate(commands)])), ", ")
    share = F.col("zero") / F.col("lookups")
    tests = [
        ("no_hooks", "medium", (F.col("total") > 0) & (F.col("hooks") == 0), F.lit("")),
        (
            "high_zero_result", "medium", (F.col("lookups") > 0) & (share >= 0.30) & (F.col("zero") >= 5),
            F.concat(F.round(share * 100).cast("int").cast("string"), F.lit("%"))
        ),
        ("underused_reads", "low", (F.col("total") >= 20) & (unused != ""), unused),
    ]
    if facts is not None:
        tests += [
            ("daemon_down", "high", ~F.col("running"), F.lit("")), ("unsupervised", "medium", ~F.col("supervised"), F.lit("")),
            ("never_ingested", "high", F.col("entities") == 0, F.lit("")),
            ("stale", "medium", F.col("stale_files") >= 10, F.col("stale_files").cast("string")),
        ]
    signals = F.array_compact(
        F.array(
            *[F.when(test, F.struct(F.lit(k).alias("kind"), F.lit(sev).alias("severity"), detail.alias("detail"))) for k, sev, test, detail in tests]
        )
    )
    return rows.select(*by, F.explode(signals).alias("s")).select(*by, "s.*")


def subjects(entities: DataFrame, memories: DataFrame, links: DataFrame, mtype: str = "subject", verb: str = "part-of") -> DataFrame:
    """(id, name, label, leaves, updated_at): memories of the subject type with the number of entities that are part of them; the label is the
    metadata's, else the name."""
    leaves = links.filter(F.col("linkage") == verb).groupBy(F.col("concept_id").alias("id")).agg(F.count(F.lit(1)).alias("leaves"))
    own = memories.filter(F.col("mtype") == mtype).select(
        F.col("entity_id").alias("id"), F.get_json_object("metadata", "$.label").alias("label"), "updated_at"
    )
    rows = entities.filter("kind = 'memory'").select("id", "name").join(own, "id").join(leaves, "id", "left")
    return rows.select(
        "id", "name", F.coalesce(F.nullif("label", F.lit("")), "name").alias("label"), F.coalesce("leaves", F.lit(0)).alias("leaves"), "updated_at"
    )


# Types of memories that no corpus has, and what patterns are called.
NOT_IN_CORPUS, PATTERN_TYPE, PATTERN_TAG = ("session", "session/*", "digest", "digest/*", "subject"), "impression", "pattern"


def in_corpus(name: Column, mtype: Column, tags: Column, scope: str = "memory", exclude: Sequence[str] = NOT_IN_CORPUS) -> Column:
    """Whether a memory belongs to a scope's corpus: not of an excluded type, no card of a session or digest, not tagged as a pattern, and an
    impression exactly in the scope ``pattern``."""
    if scope not in ("memory", "pattern"):
        raise ValueError(f"unknown scope {scope}")
    kind = F.coalesce(mtype, F.lit(""))
    out = ~F.coalesce(name.rlike(r"(?i)^(session|digest)[-_]"), F.lit(False)) & ~F.coalesce(
        F.array_contains(F.from_json(tags, "array<string>"), PATTERN_TAG), F.lit(False)
    )
    for glob in exclude:
        out = out & ~kind.rlike(glob_pattern(glob))
    return out & (kind == PATTERN_TYPE if scope == "pattern" else kind != PATTERN_TYPE)


def anchored_windows(rows: DataFrame, key: str, time_s: str, window_s: float = 5.0) -> DataFrame:
    """``rows`` with ``window_start``: a window opens at the first row of a key and holds the rows up to window_s later; the next row opens the next.

    Each start depends on the one before, so a key's rows are scanned in order; the scan keeps one number. Keys are cut first where a slot of
    window_s seconds is empty, as a new window begins after it in any case; slots are found and numbered by joins and ranges, so one busy key
    spreads over many groups. A stretch of
    a key without an empty slot is one group.
    """
    import pandas as pd

    names = rows.columns
    slot = F.floor(F.col(time_s) / F.lit(window_s))
    placed = rows.withColumn("_slot", slot)
    slots = placed.filter("_slot IS NOT NULL").select(F.col(key).alias("_k"), "_slot").distinct()
    before = slots.select(F.col("_k").alias("_k2"), (F.col("_slot") + 1).alias("_slot2"), F.lit(1).alias("_went"))
    flagged = slots.join(before, F.col("_k").eqNullSafe(F.col("_k2")) & (F.col("_slot") == F.col("_slot2")), "left")
    flagged = flagged.select("_k", "_slot", F.when(F.col("_went").isNull(), 1).otherwise(0).cast("long").alias("_new"))
    runs = running_totals(flagged, ["_k"], ["_slot"], "_new", total="_stretch").select("_k", F.col("_slot").alias("_s"), "_stretch")
    cut = placed.join(runs, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_slot") == F.col("_s"))).select(*names, "_stretch")
    schema = T.StructType([*rows.schema.fields, T.StructField("window_start", T.DoubleType())])

    def scan(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(time_s, kind="stable")
        start, out = None, []
        for t in frame[time_s]:
            if start is None or t > start + window_s:
                start = t
            out.append(start)
        return plain_strings(frame[names]).assign(window_start=out)

    cut = stage(cut, "window-runs")
    ends = cut.groupBy(F.col(key).alias("_k"), F.col("_stretch").alias("_r")).agg(F.min(time_s).alias("_first"), F.max(time_s).alias("_last"))
    cut = cut.join(ends, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_stretch") == F.col("_r")))
    # A run no longer than the window is one window; only longer ones need the scan.
    short = F.col("_last") - F.col("_first") <= window_s
    plain = cut.filter(short).select(*names, F.col("_first").cast("double").alias("window_start"))
    return plain.unionByName(cut.filter(~short).select(*names, "_stretch").groupBy(key, "_stretch").applyInPandas(scan, schema))


# --- channels ---------------------------------------------------------------------------------------


def channel_stats(messages: DataFrame) -> DataFrame:
    """(channel, n, active, archived, deleted, last_seq)."""
    status = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0)).alias(s)
    return messages.groupBy("channel").agg(
        F.count(F.lit(1)).alias("n"), status("active"), status("archived"), status("deleted"), F.max("seq").alias("last_seq")
    )


def unread(messages: DataFrame, cursors: DataFrame) -> DataFrame:
    """(agent, channel, unread): active messages after an agent's cursor; an agent without a cursor on a channel isn't listed."""
    # A cursor takes its place among the messages, and what comes after it is the channel's total less the running one.
    sent = messages.filter("status = 'active'").select(
        "channel", "seq", F.lit(0).alias("is_cursor"), F.lit("").alias("agent"), F.lit(1).cast("long").alias("one")
    )
    kind = cursors.schema["agent"].dataType
    held = cursors.select(
        "channel", F.col("last_seq").alias("seq"), F.lit(1).alias("is_cursor"), F.col("agent").cast("string").alias("agent"),
        F.lit(0).cast("long").alias("one")
    )
    placed = running_totals(sent.unionByName(held), ["channel"], ["seq", "is_cursor", "agent"], "one")
    return placed.filter("is_cursor = 1").select(
        F.col("agent").cast(kind).alias("agent"), "channel", (F.col("whole") - F.col("running")).alias("unread")
    )


def read_channel(messages: DataFrame, cursors: DataFrame, agent: str, pattern: str, n: int) -> tuple[DataFrame, DataFrame]:
    """The next n active messages for an agent on the channels of a pattern, by seq over all of them, and the agent's new cursors.

    A cursor moves to the smaller of the channel's last message and the last seq that was returned, so nothing is skipped; n = 0 is a peek that
    returns
    and moves nothing.
    """
    mine = cursors.filter(F.col("agent") == agent).select("channel", F.col("last_seq").alias("cursor"))
    rows = messages.filter(
        (F.col("status") == "active") & channel_matches(F.col("channel"), pattern)
    ).join(mine, "channel", "left").filter(F.col("seq") > F.coalesce("cursor", F.lit(0)))
    got = rows.orderBy("seq").limit(n)
    last = got.agg(F.max("seq").alias("last")).withColumn("one", F.lit(1))
    seen = rows.groupBy("channel").agg(F.max("seq").alias("newest"), F.max("cursor").alias("cursor")).withColumn("one", F.lit(1)).join(last, "one")
    moved = seen.filter("last IS NOT NULL").select(
        F.lit(agent).alias("agent"), "channel", F.greatest(F.coalesce("cursor", F.lit(0)), F.least("newest", "last")).alias("last_seq")
    )
    return got.drop("cursor"), moved


def retired(messages: DataFrame, channel: str, before: Column, status: str) -> DataFrame:
    """Messages with those of a channel from before a time set to a status (archived, deleted, active)."""
    old = (F.col("channel") == channel) & (F.col("ts") < before)
    return messages.withColumn("status", F.when(old, status).otherwise(F.col("status")))


def purged(messages: DataFrame, statuses: Sequence[str] = ("deleted",)) -> DataFrame:
    return messages.filter(~F.col("status").isin(list(statuses)))


# --- windows and prefixes ----------------------------------------------------------------------------


def budget_prefix(ranked: DataFrame, groups: Sequence[str], order: Sequence[Column], cost: Column, budget: int, most: int) -> DataFrame:
    """The entries of a ranking taken before the first that overflows the budget (or the number): the fill stops there, it doesn't skip."""
    w = W.partitionBy(*groups).orderBy(*order) if groups else W.partitionBy(F.lit(1)).orderBy(*order)
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    return ranked.withColumn("used", F.sum(cost).over(upto)).withColumn("place", F.row_number().over(w)).filter(
        (F.col("used") <= budget) & (F.col("place") <= most)
    )


def first_seen(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def without_repeats(rows: DataFrame, group: Sequence[str], order: Sequence[Column], value: str) -> DataFrame:
    """Rows whose value differs from the one before them in their group."""
    before = F.lag(value).over(W.partitionBy(*group).orderBy(*order))
    return rows.withColumn("_b", before).filter(F.col("_b").isNull() | ~F.col(value).eqNullSafe(F.col("_b"))).drop("_b")


def around(rows: DataFrame, group: Sequence[str], order: Sequence[Column], hit: Column, n: int) -> DataFrame:
    """Rows at most n places before or after one for which ``hit`` holds."""
    w = W.partitionBy(*group).orderBy(*order).rowsBetween(-n, n)
    return rows.withColumn("_h", F.max(hit.cast("int")).over(w)).filter("_h = 1").drop("_h")


def turns(rows: DataFrame, group: Sequence[str], order: Sequence[Column], starts: Column) -> DataFrame:
    """Rows with ``turn``: how many starting rows came up to and with it."""
    return rows.withColumn(
        "turn", F.sum(F.when(starts, 1).otherwise(0)).over(W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    )


def round_robin(rows: DataFrame, scope: str, name: str, order: Sequence[Column], k: int) -> DataFrame:
    """The first k names, taken from the scopes in turn; a name that several scopes have comes once."""
    ranked = rows.withColumn("place", F.row_number().over(W.partitionBy(scope).orderBy(*order)))
    once = ranked.groupBy(name).agg(F.min(F.struct("place", scope)).alias("at")).select(name, "at.place", F.col(f"at.{scope}").alias(scope))
    return once.orderBy("place", scope, name).limit(k)


def retained(rows: DataFrame, group: Sequence[str], order: Sequence[Column], most: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")


# --- filters --------------------------------------------------------------------------------------------


def select_entities(
    entities: DataFrame, names: Sequence[str] | None = None, like: str | None = None, ns: str | None = None, kind: str | None = None,
    protected: bool | None = None, noise: bool | None = None
) -> DataFrame:
    """Entities for which every given condition holds."""
    out = entities
    if names is not None:
        out = out.filter(F.col("name").isin(list(names)))
    if like is not None:
        out = out.filter(F.col("name").like(like.replace("*", "%")))
    if ns is not None:
        out = out.filter(F.col("name").startswith(f"{ns}/"))
    if kind is not None:
        out = out.filter(F.col("kind") == kind)
    for flag, want in (("protected", protected), ("noise", noise)):
        if want is not None:
            out = out.filter(F.coalesce(flag, F.lit(0)) == int(want))
    return out


def tagged(memories: DataFrame, tags: Sequence[str], any_of: bool = False) -> DataFrame:
    """Memories with all of the tags, or any of them."""
    own = F.from_json("tags", "array<string>")
    want = F.array(*[F.lit(t) for t in tags])
    return memories.filter(F.coalesce(F.arrays_overlap(own, want) if any_of else F.size(F.array_except(want, own)) == 0, F.lit(False)))


def without_types(memories: DataFrame, globs: Sequence[str]) -> DataFrame:
    out = memories
    for g in globs:
        out = out.filter(~F.coalesce(F.col("mtype").rlike(glob_pattern(g)), F.lit(False)))
    return out


def recent(memories: DataFrame, now: float, seconds: float, k: int) -> DataFrame:
    """The newest memories of a time window, or of all time if the window is empty."""
    inside = memories.withColumn("_in", F.col("created_at") >= now - seconds)
    any_in = F.max(F.col("_in").cast("int"))
    newest = inside.orderBy(F.desc("_in"), F.desc_nulls_last("created_at"), "entity_id").limit(k)
    return newest.withColumn("_any", any_in.over(W.partitionBy(F.lit(1)))).filter("_in OR coalesce(_any, 0) = 0").drop("_in", "_any")


def stale(tracked: DataFrame, disk: DataFrame) -> DataFrame:
    """(path, state): tracked absolute paths that are gone (``missing``) or newer than their last sync (``changed``)."""
    rows = tracked.join(disk.select("path", F.col("mtime").alias("now")), "path", "left")
    state = F.when(F.col("now").isNull() & F.col("path").startswith("/"), "missing").when(F.col("now") > F.col("last_synced") + 0.001, "changed")
    return rows.select("path", state.alias("state")).filter("state IS NOT NULL")


def session_stats(events: DataFrame, session: str, kind: str, ok: str) -> DataFrame:
    """(session, turns, actions, errors, tools): turns by prompts, actions by tool calls, and the calls of each tool."""
    per = events.groupBy(session, kind).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(~F.col(ok), 1).otherwise(0)).alias("bad"))
    return per.groupBy(session).agg(
        F.sum(F.when(F.col(kind) == "prompt", F.col("n")).otherwise(0)).alias("turns"),
        F.sum(F.when(F.col(kind) != "prompt", F.col("n")).otherwise(0)).alias("actions"), F.sum("bad").alias("errors"),
        F.array_sort(F.collect_list(F.struct(kind, "n"))).alias("tools"),
    )
