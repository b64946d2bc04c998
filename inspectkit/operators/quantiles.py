"""Exact linear-interpolated quantiles without a value->count map per group.

``percentile`` keeps every distinct value of a group in one aggregation
buffer and merges them in one task: fine for low-cardinality columns, a
memory hazard for a continuous column at scale.  Here a mergeable KLL sketch
finds where the values lie, and counting finds which they are:

1. one aggregation, for all columns at once: the count ``n`` and a sketch of
   ``K`` items, some 200 KB.  With 99 % confidence the rank of a value it
   names is off by at most 2.296 / K^0.9021 of n; twice that either side of a
   wanted rank is the bracket [L, U] of the order statistics at the ranks floor(h)
   and ceil(h), h = p (n - 1);
2. while a bracket is expected to hold more than ``HELD`` rows, the same again
   inside the brackets: each round leaves a thousandth;
3. one counting pass: the rows below L, and those inside by value.  Equal values are
   combined before the shuffle, so a hot value costs nothing; a running count over at
   most about ``HELD`` values picks the two order statistics.

The counts show a bracket that missed; it is widened and counted again, at last over
the whole range.  The columns are written once, so no pass computes
them again, and brackets enter the passes as literals.

With groups, every group has its own sketch and bracket, joined to its rows by
the group key; groups are counted as in step 3.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inspectkit.session import checkpoint_dir, written

K = 16384
HELD = 1_000_000


def rank_error(k: int) -> float:
    """Share of the rows by which a sketch of k items misplaces a value, at most (99 %)."""
    return min(1.0, 2.296 / k**0.9021)


def _finite(v: Column) -> Column:
    v = v.cast("double")
    return F.when(~F.isnan(v), v)


def _sketched(v: Column, k: int, probs: list[float], n: Column) -> Column:
    at = F.array(*map(F.lit, probs))
    return F.when(n > 0, F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(v, F.lit(k)), at))


class _Slot:
    """One wanted quantile: column, probability, and where it is known to lie."""

    def __init__(self, col: int, p: float, n: int):
        self.col, self.n, self.h = col, n, p * (n - 1)
        self.low, self.high, self.below, self.inside, self.slack = None, None, 0, n, 1.0

    def within(self, v: Column) -> Column:
        ok = v.isNotNull()
        if self.low is not None:
            ok = ok & (v >= F.lit(self.low))
        return ok if self.high is None else ok & (v <= F.lit(self.high))

    def narrowed(self, k: int) -> list[float]:
        """Probabilities, inside the bracket, of the ends of the next one."""
        wide = 2 * rank_error(k) * self.slack
        at = ((math.floor(self.h) - self.below) / self.inside, (math.ceil(self.h) + 1 - self.below) / self.inside)
        return [max(0.0, at[0] - wide), min(1.0, at[1] + wide)]


def column_quantiles(df: DataFrame, cols: list[str], probs: list[float], k: int = K, stored: bool = False) -> dict[str, list[float | None]]:
    """The linear-interpolated quantiles of each column at ``probs`` (NULLs and NaNs
    ignored; None without values).  ``stored``: df is a written table."""
    names = [f"v{i}" for i in range(len(cols))]
    d = df.select(*[_finite(F.col(f"`{c}`")).alias(v) for c, v in zip(cols, names)])
    if not stored:
        d = written(d, "quantile-columns")
    counts = d.agg(*[F.count(v).alias(v) for v in names]).first()
    slots = [_Slot(i, float(p), counts[v]) for i, v in enumerate(names) for p in probs if counts[v]]
    slots_of = {}
    for s, (i, j) in zip(slots, [(i, j) for i, v in enumerate(names) for j in range(len(probs)) if counts[v]]):
        slots_of[i, j] = s
    open_ = [s for s in slots if s.inside > HELD or s.n > 4 / rank_error(k)]
    rounds = 0
    while open_ and rounds < 8:  # brackets first from the whole columns, then from inside the last ones
        aggs = []
        for i, s in enumerate(open_):
            v = F.col(names[s.col])
            aggs.append(_sketched(F.when(s.within(v), v), k, s.narrowed(k), F.count(F.when(s.within(v), v))).alias(f"b{i}"))
        found = d.agg(*aggs).first()
        for i, s in enumerate(open_):
            if found[f"b{i}"] is not None:
                s.low, s.high = found[f"b{i}"]
        rounds += 1
        if not any(4 * rank_error(k) ** rounds * s.n > HELD for s in open_):
            break
        # next round: exact counts of what is below and inside
        aggs = []
        for i, s in enumerate(open_):
            v = F.col(names[s.col])
            aggs += [F.count(F.when(v < F.lit(s.low), 1)).alias(f"l{i}"), F.count(F.when(s.within(v), 1)).alias(f"n{i}")]
        row = d.agg(*aggs).first()
        for i, s in enumerate(open_):
            if row[f"l{i}"] <= math.floor(s.h) and row[f"l{i}"] + row[f"n{i}"] > math.ceil(s.h):
                s.below, s.inside = row[f"l{i}"], row[f"n{i}"]
            else:  # missed: again from the whole column, wider
                s.low = s.high = None
                s.below, s.inside, s.slack = 0, s.n, 4 * s.slack
        open_ = [s for s in open_ if s.inside > HELD and (s.low is None or s.low < s.high)]
    picks = _picked(d, names, slots)
    missed = [s for s in slots if picks.get(id(s)) is None]
    while missed:
        for s in missed:
            s.low = s.high = None  # the whole range: ordered by shuffles that spill
        picks |= _picked(d, names, missed)
        missed = [s for s in missed if picks.get(id(s)) is None]
    return {c: [picks[id(slots_of[i, j])] if (i, j) in slots_of else None for j in range(len(probs))] for i, c in enumerate(cols)}


def _picked(d: DataFrame, names: list[str], slots: list[_Slot]) -> dict[int, float | None]:
    """One counting pass: value of each slot, None where its bracket missed."""
    if not slots:
        return {}
    cells = []
    for i, s in enumerate(slots):
        v = F.col(names[s.col])
        kept = F.when(s.within(v), v)
        used = v.isNotNull() if s.high is None else v <= F.lit(s.high)
        cells.append(F.when(used, F.struct(F.lit(i).alias("slot"), kept.alias("v"))))
    rows = d.select(F.explode(F.array(*cells)).alias("c")).where("c is not null").select("c.slot", "c.v")
    counted = rows.groupBy("slot", "v").agg(F.count(F.lit(1)).alias("n"))
    # rows below a bracket have no value and come first; a slot's values are bounded (HELD)
    so_far = Window.partitionBy("slot").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0)
    counted = counted.withColumn("upto", F.sum("n").over(so_far))
    low = F.element_at(F.array(*[F.lit(math.floor(s.h)) for s in slots]), F.col("slot") + 1)
    high = F.element_at(F.array(*[F.lit(math.ceil(s.h)) for s in slots]), F.col("slot") + 1)
    found = counted.groupBy("slot").agg(
        F.min(F.when(F.col("upto") > low, F.struct(F.coalesce("v", F.lit(-math.inf)).alias("v")))).alias("a"),
        F.min(F.when(F.col("upto") > high, F.struct(F.coalesce("v", F.lit(-math.inf)).alias("v")))).alias("b"),
        F.coalesce(F.max(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("below"))
    out = {}
    for r in found.collect():
        s = slots[r.slot]
        if r.a is not None and r.b is not None and (s.low is None or r.below <= math.floor(s.h)):
            out[id(s)] = r.a.v + (s.h - math.floor(s.h)) * (r.b.v - r.a.v) if r.b.v != r.a.v else r.a.v
    return out


def _attach(df: DataFrame, stats: DataFrame, by: list[str]) -> DataFrame:
    s = stats
    for g in by:
        s = s.withColumnRenamed(g, f"__g_{g}")
    cond = [F.col(g).eqNullSafe(F.col(f"__g_{g}")) for g in by]
    return df.join(s, cond, "inner").drop(*[f"__g_{g}" for g in by])


def exact_quantiles(df: DataFrame, col: str, probs: list[float], by: list[str] | tuple[str, ...] = (),
                    accuracy: int = K) -> DataFrame:
    """``(by..., q0, q1, ...)``: the linear-interpolated quantiles of ``col``
    at ``probs`` per group (NULLs ignored; a group without values gives NULL).
    ``accuracy``: items of a sketch."""
    by = list(by)
    probs = [float(p) for p in probs]
    if not by:
        q = column_quantiles(df, [col], probs, min(max(accuracy, 8), 65535))[col]
        return df.sparkSession.createDataFrame([tuple(q)], ", ".join(f"q{i} double" for i in range(len(probs))))
    v = F.col(f"`{col}`").cast("double")
    d = df.select(*by, v.alias("__v")).filter(F.col("__v").isNotNull() & ~F.isnan("__v"))
    items = min(max(accuracy, 8), 65535)
    delta = 2 * rank_error(items) if accuracy > 2 else 1.0
    ends = [max(0.0, p - delta) for p in probs] + [min(1.0, p + delta) for p in probs]
    n = F.count(F.lit(1))
    st = d.groupBy(*by).agg(n.alias("__n"), _sketched(F.col("__v"), items, ends, n).alias("__br"))
    k = len(probs)
    st = st.select(*by, "__n", *[
        x for i in range(k) for x in (F.col("__br")[i].alias(f"__L{i}"), F.col("__br")[k + i].alias(f"__U{i}"))])
    # a sketch draws at random: both passes below must see the same brackets, in a
    # file, whose size is known: the rows are not shuffled by group for a small table
    j = _attach(d, written(st, "quantile-brackets"), by)
    # per row and p: below the bracket, or inside it (then keep the value)
    rows = j.select(*by, "__n", "__v", F.explode(F.array(*[
        F.struct(F.lit(i).alias("p"), F.col(f"__L{i}").alias("L"), F.col(f"__U{i}").alias("U")) for i in range(k)
    ])).alias("__b"))
    rows = rows.select(*by, "__n", "__v", "__b.p", "__b.L", "__b.U")
    below = rows.groupBy(*by, "p").agg(F.count(F.when(F.col("__v") < F.col("L"), 1)).alias("__below"),
                                       F.first("__n").alias("__n"))
    inside = rows.filter((F.col("__v") >= F.col("L")) & (F.col("__v") <= F.col("U"))).groupBy(
        *by, "p", "__v").agg(F.count(F.lit(1)).alias("__c"))
    # running count over the (few) bracketed values of each (group, p)
    w = Window.partitionBy(*by, "p").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("__cum", F.sum("__c").over(w))
    keys = by + ["p"]
    cond = [inside[x].eqNullSafe(below[x]) for x in keys]
    z = below.join(inside, cond, "left").select(*[below[x] for x in keys], "__below", "__n", "__v", "__c", "__cum")
    h = F.element_at(F.array(*[F.lit(p) for p in probs]), F.col("p") + 1) * (F.col("__n") - 1).cast("double")
    z = z.withColumn("__h", h).withColumn("__rlo", F.floor("__h")).withColumn("__rhi", F.ceil("__h"))
    # the value at 0-based rank r is the first bracketed value whose running
    # count (plus the rows below the bracket) exceeds r
    pick = z.groupBy(*keys).agg(
        F.first("__below").alias("__below"), F.first("__n").alias("__n"), F.first("__h").alias("__h"),
        F.min(F.when(F.col("__below") + F.col("__cum") > F.col("__rlo"), F.col("__v"))).alias("__xlo"),
        F.min(F.when(F.col("__below") + F.col("__cum") > F.col("__rhi"), F.col("__v"))).alias("__xhi"),
        F.sum("__c").alias("__inside"),
    )
    ok = (F.col("__n") == 0) | ((F.col("__below") <= F.floor("__h"))
                                & (F.col("__below") + F.coalesce(F.col("__inside"), F.lit(0)) > F.ceil("__h")))
    # the per-(group, p) table is small; it is written to the shared
    # checkpoint folder so the bracket check and the result read it instead
    # of recomputing both passes
    checkpoint_dir(df.sparkSession)
    pick = pick.withColumn("__ok", ok).checkpoint(eager=True)
    if pick.filter(~F.col("__ok")).limit(1).count():
        if accuracy <= 2:
            raise RuntimeError("quantile ranks fall outside the range of the values")
        return exact_quantiles(df, col, probs, by, max(accuracy // 4, 2))
    q = F.when(F.col("__n") > 0, F.col("__xlo") + (F.col("__h") - F.floor("__h")) * (F.col("__xhi") - F.col("__xlo")))
    res = pick.select(*keys, q.alias("__q"))
    wide = res.groupBy(*by).pivot("p", list(range(k))).agg(F.first("__q"))
    return wide.select(*by, *[F.col(str(i)).alias(f"q{i}") for i in range(k)])


def quantile_columns(df: DataFrame, cols: list[str], probs: list[float], by=(), accuracy: int = K) -> DataFrame:
    """Several columns at once: ``(by..., <col>_q0, <col>_q1, ...)``.  With groups the
    columns are stacked into (column, value) rows and the column becomes a group key."""
    by = list(by)
    if not by:
        found = column_quantiles(df, cols, probs, min(max(accuracy, 8), 65535))
        names = ", ".join(f"`{c}_q{j}` double" for c in cols for j in range(len(probs)))
        return df.sparkSession.createDataFrame([tuple(x for c in cols for x in found[c])], names)
    stacked = df.select(*by, F.explode(F.array(*[
        F.struct(F.lit(i).alias("__col"), F.col(f"`{c}`").cast("double").alias("__x")) for i, c in enumerate(cols)
    ])).alias("__s")).select(*by, "__s.__col", "__s.__x")
    q = exact_quantiles(stacked, "__x", probs, by + ["__col"], accuracy)
    k = len(probs)
    aggs = [F.first(F.when(F.col("__col") == i, F.col(f"q{j}")), ignorenulls=True).alias(f"{c}_q{j}")
            for i, c in enumerate(cols) for j in range(k)]
    return q.groupBy(*by).agg(*aggs)
