"""Global order statistics without a single-partition window.

``global_rank`` gives every row its unique 1-based position in a total
order, and the row count, as a distributed job:

1. range-partition on the order keys (sampled bounds; a hot key value is
   split across partitions by the tie-break keys), sort within partitions;
2. local position = ``monotonically_increasing_id`` minus the partition's
   base (partition index << 33);
3. the tagged rows are written once to the shared checkpoint folder, so
   the sizes and the rows come from one materialisation (range bounds are
   sampled and could differ between two evaluations of a shuffled input);
4. sizes per partition (one row per partition) -> running offsets -> a
   broadcast join of that partition-count-sized table.

On top of it: equal-frequency bins (``qcut`` of ``rank(method='first')``).
Exact interpolated quantiles are found by radix selection instead.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickspark.functions.numeric import ordered_key, qcut_bucket, value_of_key
from clickspark.staging import stage_table


def global_rank(df: DataFrame, order: Sequence[Column], rank_col: str = "rn",
                count_col: str = "n", num_partitions: int | None = None) -> DataFrame:
    """Add ``rank_col`` (unique position 1..n in ``order``) and ``count_col``
    (n).  ``order`` should be a total order (end with a unique key) for the
    ranks to be reproducible; for order statistics of values any order of
    equal values gives the same answer."""
    order = list(order)
    pid = F.spark_partition_id()
    # Without an explicit count AQE may merge adjacent small ranges (order is
    # kept, so partition ids stay monotone in the key); a hot key is still
    # split by the tie-break keys.
    ranged = (df.repartitionByRange(int(num_partitions), *order) if num_partitions
              else df.repartitionByRange(*order))
    tagged = (ranged.sortWithinPartitions(*order)
                .withColumn("_pid", pid)
                .withColumn("_lrn", F.monotonically_increasing_id()
                            - F.shiftleft(pid.cast("long"), 33) + F.lit(1)))
    tagged = stage_table(tagged)
    sizes = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    # one row per partition: bounded by the partition count, not the data
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.select("_pid",
                        F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"),
                        F.sum("_cnt").over(Window.partitionBy()).alias(count_col))
    return (tagged.join(F.broadcast(offs), "_pid")
                  .withColumn(rank_col, (F.col("_off") + F.col("_lrn")).cast("long"))
                  .drop("_pid", "_lrn", "_off"))


def qcut_rank(df: DataFrame, value: str, q: int, tie: Sequence[str] = ("user_id",),
              out: str = "bin", descending_good: bool = False,
              num_partitions: int | None = None) -> DataFrame:
    """``qcut(series.rank(method='first'), q, labels=False) + 1`` with ties in
    ``value`` broken by ``tie`` columns (the order of arrival in the
    reference).  ``descending_good`` flips to ``q + 1 - bin``; a null value
    has no rank and no bin."""
    r = global_rank(df.where(F.col(value).isNotNull()), [F.col(value).asc()] + [F.col(t).asc() for t in tie],
                    rank_col="_rn", count_col="_n", num_partitions=num_partitions)
    b = qcut_bucket("_rn", "_n", q)
    if descending_good:
        b = F.lit(q + 1) - b
    without = df.where(F.col(value).isNull()).withColumn(out, F.lit(None).cast("int"))
    return r.withColumn(out, b.cast("int")).drop("_rn", "_n").unionByName(without)


def qcut_ranks(df: DataFrame, specs: Sequence[tuple[str, str, bool]], q: int,
               tie: Sequence[str] = ("user_id",), num_partitions: int | None = None) -> DataFrame:
    """Several ``qcut_rank`` scores in one ranking pass.  ``specs`` lists
    ``(value column, output column, descending_good)``; ``tie`` must be a
    key of ``df``.  The values are stacked as (metric, value, key) rows and
    ranked once by (metric, value, key): each metric occupies a contiguous
    block of ranks whose start comes from a per-metric count (one row per
    metric).  The bins are regrouped to one row per key and joined back."""
    tie = list(tie)
    st = F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col(c).cast("double").alias("v"))
                             for i, (c, _, _) in enumerate(specs)])).alias("_s")
    stacked = df.select(*tie, st).select(*tie, "_s.m", "_s.v").where(F.col("v").isNotNull())
    r = global_rank(stacked, [F.col("m"), F.col("v")] + [F.col(t) for t in tie],
                    rank_col="_rn", count_col="_n", num_partitions=num_partitions)
    counts = {row["m"]: row["c"] for row in r.groupBy("m").agg(F.count(F.lit(1)).alias("c")).collect()}
    start, acc = {}, 0
    for i in range(len(specs)):
        start[i] = acc
        acc += counts.get(i, 0)
    off, n = F.lit(0), F.lit(0)
    for i in range(len(specs)):
        off = F.when(F.col("m") == i, F.lit(start[i])).otherwise(off)
        n = F.when(F.col("m") == i, F.lit(counts.get(i, 0))).otherwise(n)
    b = qcut_bucket(F.col("_rn") - off, n, q)
    binned = r.select(*tie, "m", b.alias("_bin"))
    wide = binned.groupBy(*tie).agg(*[
        (F.lit(q + 1) - F.max(F.when(F.col("m") == i, F.col("_bin")))).cast("int").alias(out) if desc
        else F.max(F.when(F.col("m") == i, F.col("_bin"))).cast("int").alias(out)
        for i, (_, out, desc) in enumerate(specs)])
    return df.join(wide, tie, "left")


#: Bits of the key that a pass resolves, and the rows of wanted bins that are
#: fetched as (key, count) pairs once that few are left.
RADIX, PICK = 11, 10_000


def _keys(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, list[bool]]:
    """One bigint key per column whose order is the values' order, and which
    columns hold whole numbers (their own keys)."""
    types = dict(df.dtypes)
    whole = [types[c] in ("tinyint", "smallint", "int", "bigint") for c in cols]
    return df.select(*[F.col(c).cast("long").alias(f"k{i}") if w else ordered_key(F.col(c).cast("double")).alias(f"k{i}")
                       for i, (c, w) in enumerate(zip(cols, whole))]), whole


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                     method: str = "numpy", materialize: bool = False) -> dict[str, list[float | None]]:
    """Exact linearly interpolated quantiles of several numeric columns
    (pandas ``quantile`` / SQL ``quantile_cont``) as ``{column: [value per
    prob]}``; nulls and NaN are ignored, -0.0 is 0.0.

    Radix selection, no sort: every value has a 64-bit key of the same order
    (``ordered_key``).  The first pass counts the keys by their top ``RADIX``
    bits; each further pass counts, inside every bin that still holds a wanted
    order statistic, by the next ``RADIX`` bits of the bin's own range (its
    least and greatest key are known from the pass before).  So the range left
    shrinks by ``RADIX`` bits a pass whatever the values, and six passes at most
    find the ranks.  A bin of one value is done whatever its count, so a
    repeated value costs nothing; when ``PICK`` rows at most are left they come
    as (key, count) pairs.  Every pass is a map-side combined aggregate of at
    most 2^RADIX rows per wanted rank.  ``materialize`` writes the keys once for
    the passes.  ``method`` ``numpy`` uses numpy's two-sided interpolation,
    ``sql`` the one-sided form."""
    cols = list(cols)
    keys, whole = _keys(df, cols)
    keys = stage_table(keys) if materialize else keys
    st = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"k{i}").alias("k")) for i in range(len(cols))])).alias("_s")
    stacked = keys.select(st).select("_s.c", "_s.k").where(F.col("k").isNotNull())

    def histogram(rows: DataFrame, by: Column) -> list:
        return rows.withColumn("b", by).where("b is not null").groupBy("c", "b").agg(
            F.min("k").alias("lo"), F.max("k").alias("hi"), F.count(F.lit(1)).alias("n")).collect()

    size: dict[int, int] = {}
    found: dict[tuple[int, int], int] = {}                     # (column, 0-based rank) -> key
    left: list[tuple[int, int, int, int, int, list[int]]] = []  # column, low, high, rows before, rows, ranks

    def narrow(c: int, bins: list, before: int, ranks: list[int]) -> None:
        for _, lo, hi, n in sorted(bins):
            inside = [r for r in ranks if before <= r < before + n]
            if inside and lo == hi:
                found.update({(c, r): lo for r in inside})
            elif inside:
                left.append((c, lo, hi, before, n, inside))
            before += n

    top: dict[int, list] = {}
    for r in histogram(stacked, F.shiftright("k", 64 - RADIX)):
        top.setdefault(r["c"], []).append((r["b"], r["lo"], r["hi"], r["n"]))
    for c, bins in top.items():
        size[c] = n = sum(x[3] for x in bins)
        narrow(c, bins, 0, sorted({x for p in probs for x in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))}))
    while left:
        now, left = left, []
        inside = [(F.col("c") == c) & F.col("k").between(F.lit(lo), F.lit(hi)) for c, lo, hi, *_ in now]
        if sum(x[4] for x in now) <= PICK:
            rows = stacked.where(functools.reduce(operator.or_, inside)).groupBy("c", "k").agg(
                F.count(F.lit(1)).alias("n")).collect()
            parts = [(i, (r["k"], r["k"], r["k"], r["n"])) for r in rows for i, x in enumerate(now)
                     if r["c"] == x[0] and x[1] <= r["k"] <= x[2]]
        else:
            by = F
            for i, (x, cond) in enumerate(zip(now, inside)):
                shift = max(0, (x[2] - x[1]).bit_length() - RADIX)
                by = by.when(cond, F.shiftright(F.col("k") - F.lit(x[1]), shift) + F.lit(i << RADIX))
            parts = [(r["b"] >> RADIX, (r["b"], r["lo"], r["hi"], r["n"])) for r in histogram(stacked, by)]
        for i, x in enumerate(now):
            narrow(x[0], [p for j, p in parts if j == i], x[3], x[5])
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(cols):
        out[c] = []
        for p in probs:
            if i not in size:
                out[c].append(None)
                continue
            at = float(p) * (size[i] - 1)
            lo, hi = (float(k) if whole[i] else value_of_key(k) for k in (found[i, math.floor(at)], found[i, math.ceil(at)]))
            t = at - math.floor(at)
            out[c].append(lo if lo == hi else hi - (hi - lo) * (1 - t) if method == "numpy" and t >= 0.5
                          else lo + (hi - lo) * t)
    return out


def quantiles(df: DataFrame, value: str, probs: Sequence[float], names: Sequence[str] | None = None,
              method: str = "numpy", materialize: bool = True, accuracy: int | None = None) -> DataFrame:
    """``column_quantiles`` of one column as one row with a column per
    probability.  The passes are separate jobs run when this is called: of a
    derived ``df`` the keys are staged first (``materialize``; nothing else is
    written), a plain column scan can skip that.  ``accuracy`` switches to
    the one-pass ``percentile_approx`` sketch (lazy, not exact)."""
    names = list(names or [f"q{int(round(p * 100))}" for p in probs])
    if accuracy:
        v = F.col(value).cast("double")
        qa = F.percentile_approx(F.when(~F.isnan(v), v), [float(p) for p in probs], int(accuracy))
        return df.agg(qa.alias("_q")).select(*[F.col("_q")[i].alias(nm) for i, nm in enumerate(names)])
    got = column_quantiles(df, [value], probs, method, materialize)[value]
    return df.sparkSession.range(1).select(*[F.lit(x).cast("double").alias(nm) for x, nm in zip(got, names)])
