"""Differences between two copies of a table, row by row and field by field.

Keys may repeat on either side. Identical rows of the two sides cancel each other by multiplicity; the rows
left over under one key are then paired so that the paired rows differ in as few fields as possible (a
minimum-cost assignment), and what cannot be paired is missing.

Scale: rows travel as fixed-width fingerprints (64 bits a field, the epochs as they are), never with their
texts. Repeats collapse in a partial aggregation before the first shuffle, and only what doesn't cancel goes on. The
assignment runs over Arrow batches sorted by key: keys with one row on each side, the rule, are compared all at
once, others get their own matrix of differences up to ``MATRIX_CELLS`` cells, and above that the same assignment with the differences of
a row worked out whenever they are looked at. So the report is the least at any size; a key's fingerprints are held by one task, and its
time grows with the square of its rows at least.

A caller that can't wait may set ``exact_cells``: a key with more pairs of rows is first paired by joins of the rows that differ in one field, then
in two (``paired_in_rounds``), and what is left after that is assigned as a whole if it fits, in blocks of rows with neighbouring fingerprints if
not. Every row is kept; where the pairing of such a key can't be shown to cost the least (``least_cost``), the report says by how many
differences it may be too dear.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from threadloom.functions.clean import epoch_seconds
from threadloom.operators.assignment import min_cost_assignment
from threadloom.operators.prefix_sum import running_totals
from threadloom.staging import stage

EPOCH_TOLERANCE_S = 0.01
#: Differences of one key that are held at once, as a matrix; those of larger keys are worked out row by row.
MATRIX_CELLS = 100_000_000
#: Rows on a side of what is assigned in blocks, if the caller bounds what is assigned exactly.
BLOCK = 10_000
OLDEST = -1.0e300
NOT_CERTIFIED = "not_certified_minimal"


def fingerprint(col: Column, kind: str) -> Column:
    """What decides whether two values are the same: a hash of the text, of the parsed JSON, or epoch seconds."""
    if kind == "epoch":
        return epoch_seconds(col.cast("double"))
    text = col.cast("string")
    if kind == "json":
        parsed = F.to_json(F.try_parse_json(text))
        text = F.when(parsed.isNotNull(), F.concat(F.lit("j"), parsed)).otherwise(F.concat(F.lit("t"), text))
    return F.when(col.isNotNull(), F.xxhash64(text))


def differs(a: Column, b: Column, kind: str) -> Column:
    if kind == "epoch":
        return F.coalesce(F.abs(a - b) > EPOCH_TOLERANCE_S, a.isNull() != b.isNull())
    return ~a.eqNullSafe(b)


def _values(table: pa.Table, cols: Sequence[str], at: slice) -> list[tuple[np.ndarray, np.ndarray]]:
    """(values, is null) of each column; nulls read as 0, so that 64-bit numbers stay whole."""
    out = []
    for c in cols:
        column = table.column(c).slice(at.start, at.stop - at.start).combine_chunks()
        out.append((column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)))
    return out


def _unlike(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], epoch: bool) -> np.ndarray:
    """Where the values of one column differ; null equals null only."""
    (x, x_null), (y, y_null) = a, b
    other = np.abs(x - y) > EPOCH_TOLERANCE_S if epoch else x != y
    return (other & ~x_null & ~y_null) | (x_null != y_null)


class Differences:
    """The matrix of the differences of two lists of rows, given by column, of which a row is worked out whenever it is asked for."""

    def __init__(self, main: list, copy: list, epochs: Sequence[bool]):
        self.columns = list(zip(main, copy, epochs))
        self.shape = len(main[0][0]), len(copy[0][0])
        self.highest = len(self.columns)  # no pair differs in more

    def __getitem__(self, rows) -> np.ndarray:
        return sum(_unlike((x[rows], x_null[rows]), b, epoch).astype(np.int8) for (x, x_null), b, epoch in self.columns)


def fields_that_differ(
    main: list, copy: list, epochs: Sequence[bool], rows: int = 512, cells: int = MATRIX_CELLS
) -> tuple[int, np.ndarray]:
    """(pairs, differences by field) of an assignment of two lists of rows, given by column, at the fewest differences. Up to ``cells`` differences
    are held; more are worked out whenever they are needed, with the same result."""
    cost = Differences(main, copy, epochs)
    n, m = cost.shape
    if n * m <= cells:
        held = np.zeros((n, m), dtype=np.int8)
        for start in range(0, n, rows):  # in strips, which bounds the memory besides that of the costs
            strip = slice(start, start + rows)
            for (x, x_null), (y, y_null), epoch in cost.columns:
                held[strip] += _unlike((x[strip, None], x_null[strip, None]), (y[None], y_null[None]), epoch)
        cost = held
    pairs = np.array(min_cost_assignment(cost, len(epochs)), dtype=np.int64).reshape(-1, 2)
    rs, cs = pairs[:, 0], pairs[:, 1]
    differ = [_unlike((x[rs], x_null[rs]), (y[cs], y_null[cs]), e).sum() for (x, x_null), (y, y_null), e in zip(main, copy, epochs)]
    return len(pairs), np.array(differ, dtype=np.int64)


def _assigner(key_type: pa.DataType, names: Sequence[str], cols: Sequence[str], epochs: Sequence[bool], versioned: bool):
    """Over Arrow batches of (k, block, side, cols) sorted so, main rows (side 1) first: report rows (k, field, n)."""
    labels = [*names, "missing_in_copy", "missing_in_main"]

    def report(keys: pa.Array, field: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [keys.cast(key_type), pa.array([labels[i] for i in field], pa.string()), pa.array(n, pa.int64())], names=["k", "field", "n"]
        )

    def settle(rows: pa.Table, starts: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        side = rows.column("side").to_numpy()
        key = rows.column("k").combine_chunks()
        mains = np.add.reduceat(side, starts) if len(starts) else starts
        single = (mains == 1) & (ends - starts == 2)
        # One row on either side: the assignment is that pair, for all such keys at once.
        one, two = starts[single], starts[single] + 1
        at = _values(rows, cols, slice(0, rows.num_rows))
        for i, ((x, null), epoch) in enumerate(zip(at, epochs)):
            hit = one[_unlike((x[one], null[one]), (x[two], null[two]), epoch)]
            if len(hit):
                yield report(key.take(pa.array(hit)), np.full(len(hit), i), np.ones(len(hit), dtype=np.int64))
        for start, end, mid in zip(starts[~single].tolist(), ends[~single].tolist(), (starts + mains)[~single].tolist()):
            pairs, differ = fields_that_differ([(x[start:mid], u[start:mid]) for x, u in at], [(x[mid:end], u[mid:end]) for x, u in at], epochs)
            left = (0, 0) if versioned else (mid - start - pairs, end - mid - pairs)
            counts = np.r_[differ, left]
            found = np.flatnonzero(counts)
            if len(found):
                yield report(key.take(pa.array(np.full(len(found), start))), found, counts[found])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if held and _same_group(held[-1], held[-1].num_rows - 1, batch, batch.num_rows - 1):
                held.append(batch)  # still one group from before
                continue
            rows = pa.Table.from_batches([*held, batch])
            starts = _group_starts(rows)
            ends = np.r_[starts[1:], rows.num_rows]
            yield from settle(rows.slice(0, int(starts[-1])), starts[:-1], ends[:-1])
            held = rows.slice(int(starts[-1])).combine_chunks().to_batches()
        if held:
            rows = pa.Table.from_batches(held)
            starts = _group_starts(rows)
            yield from settle(rows, starts, np.r_[starts[1:], rows.num_rows])

    return run


def _same_group(a: pa.RecordBatch, i: int, b: pa.RecordBatch, j: int) -> bool:
    return a.column(0)[i].as_py() == b.column(0)[j].as_py() and a.column(1)[i].as_py() == b.column(1)[j].as_py()


def _group_starts(rows: pa.Table) -> np.ndarray:
    """Where a group of equal (k, block) starts; the table is sorted by them."""
    new = np.zeros(rows.num_rows, dtype=bool)
    new[:1] = True
    for name in ("k", "block"):
        column = rows.column(name).combine_chunks()
        here, before = column.slice(1), column.slice(0, len(column) - 1)
        changed = pc.fill_null(pc.not_equal(here, before), False).to_numpy(zero_copy_only=False)
        new[1:] |= changed | (here.is_null().to_numpy(zero_copy_only=False) != before.is_null().to_numpy(zero_copy_only=False))
    return np.flatnonzero(new)


def paired_in_rounds(rows: DataFrame, kinds: Mapping[str, str], names: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """Report (k, field, n) of rows paired because they agree in all fields but one, then in all but two, and the rows that are left.

    ``rows`` has one row (k, fields, side, copy_no) for each row left; what agrees is paired by its place on either side. Epochs come first, which
    may differ by nothing but tolerance.
    """
    cols = sorted(kinds, key=lambda c: kinds[c] != "epoch")
    agree = lambda keys: reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys])
    report = rows.select("k", F.lit("").alias("field"), F.lit(0).cast("long").alias("n")).limit(0)
    for free in [*combinations(cols, 1), *combinations(cols, 2)]:
        kept = ["k", *[c for c in cols if c not in free]]
        both = rows.groupBy(*kept).agg(F.min("side").alias("lo"), F.max("side").alias("hi")).filter("lo != hi")
        if not both.limit(1).count():
            continue
        ranked = running_totals(
            rows.withColumn("one", F.lit(1).cast("long")), [*kept, "side"], [*free, "copy_no"], "one", total="rank"
        ).drop("one", "whole")
        ranked = stage(ranked, "diff-ranked")
        one, two = ranked.filter("side = 1").alias("a"), ranked.filter("side = 0").alias("b")
        pairs = one.join(two, agree([*kept, "rank"])).select(
            F.col("a.k").alias("k"),
            F.explode(
                F.array_compact(F.array(*[F.when(differs(F.col(f"a.{c}"), F.col(f"b.{c}"), kinds[c]), F.lit(names[c])) for c in free]))
            ).alias("field")
        )
        report = report.unionByName(stage(pairs.groupBy("k", "field").agg(F.count(F.lit(1)).alias("n")), "diff-paired"))
        left = one.join(two, agree([*kept, "rank"]), "left_anti").unionByName(
            two.alias("b").join(one.alias("a"), agree([*kept, "rank"]), "left_anti")
        )
        rows = stage(left.drop("rank"), "diff-unpaired")
    return report, rows


def least_cost(rows: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """(k, least): differences that any pairing of a key's rows has at least.

    Every row of the side with fewer rows is paired, and differs in as many fields as from the row nearest to it: 0 to 2, or 3 where no row is
    that near. Epochs are
    left out, because of their tolerance, which can only make this smaller.
    """
    exact = [c for c in kinds if kinds[c] != "epoch"]
    frees = [free for n in range(3) for free in combinations(exact, n)]
    pattern = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("i"), F.lit(len(free)).alias("d"),
                    F.xxhash64(F.lit(i), *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in exact if c not in free]).alias("h")
                )
                for i,
                free in enumerate(frees)
            ]
        )
    )
    unit = rows.groupBy("k", "side", *exact).agg(F.count(F.lit(1)).alias("n"))
    flat = unit.withColumn("p", pattern).select("k", "side", *exact, "n", "p.*")
    both = flat.groupBy("k", "i", "h").agg(F.min("side").alias("lo"), F.max("side").alias("hi")).filter("lo != hi").select(
        F.col("k").alias("k2"), F.col("i").alias("i2"), F.col("h").alias("h2")
    )
    near = flat.join(both, F.col("k").eqNullSafe(F.col("k2")) & (F.col("i") == F.col("i2")) & (F.col("h") == F.col("h2")), "left")
    cost = near.groupBy("k", "side", *exact, "n").agg(F.coalesce(F.min(F.when(F.col("h2").isNotNull(), F.col("d"))), F.lit(3)).alias("d"))
    of = lambda m, what: F.sum(F.when(F.col("side") == m, what).otherwise(0))
    sides = cost.groupBy("k").agg(
        *[of(m, F.col("n")).alias(f"c{m}") for m in (1, 0)], *[of(m, F.col("n") * F.col("d")).alias(f"d{m}") for m in (1, 0)]
    )
    return sides.select(
        "k",
        F.when(F.col("c1") < F.col("c0"), F.col("d1")).when(F.col("c1") > F.col("c0"), F.col("d0")).otherwise(F.greatest("d1", "d0")).alias("least")
    )


def _fingerprints(df: DataFrame, is_main: int, key: str, fields: Mapping[str, str], version: str | None) -> DataFrame:
    seen = epoch_seconds(F.col(f"`{version}`").cast("double")) if version else F.lit(0.0)
    cols = [fingerprint(F.col(f"`{name}`"), kind).alias(f"f{i}") for i, (name, kind) in enumerate(fields.items())]
    return df.select(F.col(f"`{key}`").alias("k"), F.coalesce(seen, F.lit(OLDEST)).alias("v"), F.lit(is_main).alias("m"), *cols)


def left_over(main: DataFrame, copy: DataFrame, key: str, fields: Mapping[str, str], version: str | None = None, once: bool = True) -> DataFrame:
    """(k, v1, v0, f0, f1, ..., n1, n0): fingerprints of the rows that don't cancel, how often they are left in main (n1) or in the copy (n0).

    Of n1 equal rows in main and n0 in the copy, the difference is left on the side that has more. See ``diff_copies`` for the options; v1 and v0
    are the
    key's newest versions.
    """
    cols = [f"f{i}" for i in range(len(fields))]
    both = _fingerprints(main, 1, key, fields, version).unionByName(_fingerprints(copy, 0, key, fields, version))
    rows = both.groupBy("k", "v", "m", *cols).agg(F.count(F.lit(1)).alias("n"))
    if once:
        rows = rows.withColumn("n", F.lit(1).cast("long"))
    if version:
        of = lambda m: F.max(F.when(F.col("m") == m, F.col("v"))).alias(f"v{m}")
        newest = rows.groupBy(F.col("k").alias("k2")).agg(of(1), of(0))
        rows = rows.join(newest, F.col("k").eqNullSafe(F.col("k2"))).filter(
            F.col("v") == F.when(F.col("m") == 1, F.col("v1")).otherwise(F.col("v0"))
        ).drop("k2")
    else:
        rows = rows.withColumns({"v1": F.lit(None).cast("double"), "v0": F.lit(None).cast("double")})
    count = lambda m: F.sum(F.when(F.col("m") == m, F.col("n")).otherwise(0))
    more = lambda a, b: F.greatest(F.col(a) - F.col(b), F.lit(0)).alias(a)
    counted = rows.groupBy("k", "v1", "v0", *cols).agg(count(1).alias("n1"), count(0).alias("n0"))
    return counted.filter("n1 != n0").select("k", "v1", "v0", *cols, more("n1", "n0"), more("n0", "n1"))


def diff_copies(
    main: DataFrame, copy: DataFrame, key: str, fields: Mapping[str, str], version: str | None = None, once: bool = True,
    exact_cells: int | None = None
) -> DataFrame:
    """Report (row_id, field, n): what is missing on either side and which fields of paired rows differ.

    ``fields`` maps each compared column to ``exact``, ``json`` (key order and spacing don't matter; text that
    isn't JSON is compared as text) or ``epoch`` (seconds or milliseconds, equal within 0.01 s). field is
    ``missing_in_copy``, ``missing_in_main`` or a column's name, n the number of rows concerned. The differences of a key are as few as can be,
    whatever its size, unless the caller sets ``exact_cells``: then, for a key with more pairs of rows left, there may be
    ``not_certified_minimal``, n the differences by which its pairing may exceed the least.

    With ``version``, only the rows of a key with the largest version (null is the smallest) count on each side, and a
    key is missing only if the other side has no row of it. With ``once``, rows repeated verbatim count once.
    Null equals null and differs from every value. A null key is a key like any other. Columns that
    aren't named are ignored. Two empty tables, or equal ones, give an empty report.
    """
    names = list(fields)
    cols = [f"f{i}" for i in range(len(names))]
    kinds = dict(zip(cols, fields.values()))
    left = stage(left_over(main, copy, key, fields, version, once), "diff-left")
    sides = left.groupBy(F.col("k").alias("k2")).agg(
        F.sum("n1").alias("c1"), F.sum("n0").alias("c0"), F.max("v1").alias("w1"), F.max("v0").alias("w0")
    )
    # A side without a row left needs no pairing.
    gone_copy, gone_main = (F.col("w0").isNull(), F.col("w1").isNull()) if version else (F.lit(True), F.lit(True))
    missing = F.when((F.col("c0") == 0) & gone_copy, "missing_in_copy").when((F.col("c1") == 0) & gone_main, "missing_in_main")
    alone = sides.filter("c1 = 0 OR c0 = 0").select(
        F.col("k2").alias("k"), missing.alias("field"), (F.col("c1") + F.col("c0")).alias("n")
    ).filter("field IS NOT NULL")
    hot = F.lit(False) if exact_cells is None else F.col("c1") * F.col("c0") > exact_cells
    sides = sides.filter("c1 > 0 AND c0 > 0").select("k2", hot.alias("hot"))
    # A row that is left several times is repeated here, as often as it is left.
    rows = left.join(sides, F.col("k").eqNullSafe(F.col("k2"))).withColumn(
        "copy_no", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest("n1", "n0")))
    )
    rows = rows.select("k", *cols, F.when(F.col("n1") > 0, 1).otherwise(0).cast("long").alias("side"), "copy_no", "hot")
    assigned = rows.filter("NOT hot").drop("hot", "copy_no").withColumn("block", F.lit(0).cast("long"))
    has_hot = exact_cells is not None and sides.filter("hot").limit(1).count() > 0
    if has_hot:
        hot = stage(rows.filter("hot").drop("hot"), "diff-hot")
        in_rounds, rest = paired_in_rounds(hot, kinds, dict(zip(cols, names)))
        fits = rest.groupBy(F.col("k").alias("k2")).agg(F.sum("side").alias("c1"), F.sum(1 - F.col("side")).alias("c0"))
        fits = fits.select("k2", (F.col("c1") * F.col("c0") <= exact_cells).alias("fits"))
        ranked = running_totals(rest.withColumn("one", F.lit(1).cast("long")), ["k", "side"], [*cols, "copy_no"], "one", total="rank")
        size = max(1, min(BLOCK, int(exact_cells**0.5)))
        block = F.when(F.col("fits"), F.lit(0)).otherwise(F.floor((F.col("rank") - 1) / F.lit(size))).cast("long")
        assigned = assigned.unionByName(ranked.join(fits, F.col("k").eqNullSafe(F.col("k2"))).select("k", *cols, "side", block.alias("block")))
    key_type = left.schema["k"].dataType
    run = _assigner(to_arrow_type(key_type), names, cols, [kinds[c] == "epoch" for c in cols], bool(version))
    ordered = assigned.select("k", "block", "side", *cols).repartition("k", "block").sortWithinPartitions("k", "block", F.desc("side"), *cols)
    schema = T.StructType([T.StructField("k", key_type), T.StructField("field", T.StringType()), T.StructField("n", T.LongType())])
    paired = ordered.mapInArrow(run, schema)
    if has_hot:
        paired = stage(paired.unionByName(in_rounds), "diff-report")
        taken = paired.filter(~F.col("field").startswith("missing_in_")).groupBy(F.col("k").alias("k2")).agg(F.sum("n").alias("taken"))
        dear = least_cost(hot, kinds).join(taken, F.col("k").eqNullSafe(F.col("k2"))).select(
            "k", F.lit(NOT_CERTIFIED).alias("field"), (F.col("taken") - F.col("least")).alias("n")
        )
        paired = paired.groupBy("k", "field").agg(F.sum("n").alias("n")).unionByName(dear.filter("n > 0"))
    return alone.unionByName(paired).select(F.col("k").alias("row_id"), "field", "n")
