"""Order-dependent operators that stay distributed.

A window with ``orderBy`` but no ``partitionBy`` moves every row into one task,
and a window partitioned by a group moves a whole (possibly huge) group into one
task.  For running totals and ranks over *raw* rows we instead:

1. take approximate quantiles of the order key in one aggregate (one row of
   ``ranges - 1`` boundaries) and give every row the range its key falls in; equal
   keys share a range, and a big group spans many ranges;
2. compute running totals inside each (group, range), the one row-level shuffle;
3. add the totals of the group's earlier ranges, from a window over the
   (group, range) totals.

Nothing runs while the plan is built and nothing is checkpointed: a range is a
function of the key alone, so a recomputed task finds the same one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



def latest_row(df: DataFrame, order_col: str, cols: list[str]) -> DataFrame:
    """``ORDER BY order_col DESC LIMIT 1`` as one aggregate (``max_by`` of a struct)."""
    return df.agg(F.max_by(F.struct(*cols), F.col(order_col)).alias("r")).select("r.*")


def top_k(df: DataFrame, order_col: str, k: int, descending: bool = True) -> DataFrame:
    """Top-k rows: ``orderBy().limit()`` plans as TakeOrderedAndProject (a
    per-partition heap of k rows, then a k-way merge) — no full sort."""
    o = F.col(order_col).desc() if descending else F.col(order_col).asc()
    return df.orderBy(o).limit(k)


RANGES = 64


def running_totals(df: DataFrame, order_col: str, sum_cols: list[str], descending: bool = False,
                   group_cols: tuple[str, ...] | list[str] = (), with_totals: bool = False,
                   ranges: int = RANGES) -> DataFrame:
    """Adds ``cum_<c>``: the sum of ``c`` over the rows of the same group
    (``group_cols``; the whole frame when empty) ordered at or before this row's
    numeric key, peers included.  ``with_totals`` also adds ``tot_<c>``, the group
    total.  A null group is a group; null keys come first (last when descending).

    The totals table has at most ``ranges`` rows per group; its join with the rows is
    left to the planner."""
    groups = list(group_cols)
    shares = [i / ranges for i in range(1, ranges)]
    bounds = df.agg(F.percentile_approx(F.col(order_col).cast("double"), shares, 10_000).alias("_bounds"))
    key = F.col(order_col).cast("double")
    place = F.size(F.filter(F.coalesce("_bounds", F.array().cast("array<double>")),
                            lambda b: b < key))
    placed = df.crossJoin(F.broadcast(bounds)).withColumn(  # one row
        "_range", F.when(F.col(order_col).isNull(), F.lit(-1)).otherwise(place)).drop("_bounds")
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    inside = Window.partitionBy(*groups, "_range").orderBy(order) \
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.select("*", *[F.sum(c).over(inside).alias(f"_cum_{c}") for c in sum_cols])
    totals = placed.groupBy(*groups, "_range").agg(*[F.sum(c).alias(f"_tot_{c}") for c in sum_cols])
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    earlier = whole.orderBy(F.col("_range").desc() if descending else F.col("_range").asc()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    cols = []
    for c in sum_cols:
        cols.append(F.coalesce(F.sum(f"_tot_{c}").over(earlier), F.lit(0)).alias(f"_off_{c}"))
        if with_totals:
            cols.append(F.sum(f"_tot_{c}").over(whole).alias(f"tot_{c}"))
    offsets = totals.select(*[F.col(g).alias(f"_group_{g}") for g in groups],
                            F.col("_range").alias("_of"), *cols)
    same = F.col("_range") == F.col("_of")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_group_{g}"))
    extra = [f"tot_{c}" for c in sum_cols] if with_totals else []
    return local.join(offsets, same).select(
        *df.columns, *[(F.col(f"_cum_{c}") + F.col(f"_off_{c}")).alias(f"cum_{c}") for c in sum_cols],
        *extra)


def exact_quantiles(df: DataFrame, col: str, probs: list[float],
                    group_cols: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation (``numpy``/``pandas`` default)
    as rows ``(*group_cols, p, value)``: value frequencies -> segmented running
    counts -> each distinct value checks whether it covers the order
    statistics ``floor((n - 1) p)`` and ``ceil((n - 1) p)`` of its group."""
    groups = list(group_cols)
    freq = df.where(F.col(col).isNotNull()).groupBy(*groups, F.col(col).alias("v")) \
        .agg(F.count(F.lit(1)).alias("cnt"))
    run = running_totals(freq, "v", ["cnt"], group_cols=groups, with_totals=True)
    start, stop = F.col("cum_cnt") - F.col("cnt"), F.col("cum_cnt")
    h = (F.col("tot_cnt") - 1) * F.col("p")
    per_p = run.select(*groups, "v", start.alias("start"), stop.alias("stop"),
                       F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p"),
                       "tot_cnt") \
        .select(*groups, "v", "start", "stop", "p", h.alias("h"), F.floor(h).alias("lo"),
                F.ceil(h).alias("hi"))
    covers = lambda k: (F.col(k) >= F.col("start")) & (F.col(k) < F.col("stop"))
    hit = per_p.where(covers("lo") | covers("hi"))
    pv = hit.groupBy(*groups, "p").agg(
        F.max(F.when(covers("lo"), F.col("v"))).cast("double").alias("x_lo"),
        F.max(F.when(covers("hi"), F.col("v"))).cast("double").alias("x_hi"),
        F.first("h").alias("h"), F.first("lo").alias("lo"))
    return pv.select(*groups, "p", (F.col("x_lo") + (F.col("h") - F.col("lo"))
                                    * (F.col("x_hi") - F.col("x_lo"))).alias("value"))


def rank_within(df: DataFrame, group_col: str, order_col: str, tie_col: str,
                name: str = "rank_in_group", size_name: str | None = None) -> DataFrame:
    """``ROW_NUMBER() OVER (PARTITION BY group ORDER BY order_col, tie_col)`` without
    pulling a (possibly huge) group into one task: the rows before a key are a
    running total over key frequencies, and only rows of one key are ranked together.
    A null group is a group.  ``size_name`` adds the group size."""
    freq = df.groupBy(group_col, order_col).agg(F.count(F.lit(1)).alias("_one"))
    run = running_totals(freq, order_col, ["_one"], group_cols=[group_col], with_totals=True)
    before = run.select(F.col(group_col).alias("_g"), F.col(order_col).alias("_k"),
                        (F.col("cum__one") - F.col("_one")).alias("_before"),
                        F.col("tot__one").alias("_size"))
    peers = F.row_number().over(Window.partitionBy(group_col, order_col).orderBy(tie_col))
    out = df.withColumn("_peer", peers).join(
        before, F.col(group_col).eqNullSafe(F.col("_g")) & F.col(order_col).eqNullSafe(F.col("_k")))
    return out.select(*df.columns, (F.col("_before") + F.col("_peer")).cast("bigint").alias(name),
                      *([F.col("_size").alias(size_name)] if size_name else []))


HEAVY_GROUP = 1_000_000


def place_within(df: DataFrame, group_col: str, order_col: str, name: str = "place",
                 heavy: int = HEAVY_GROUP, ranges: int = RANGES) -> DataFrame:
    """Adds ``name``: 0 for the row with the largest ``order_col`` of its group, 1 for the next...

    Null keys come last, a null group is a group, and rows of one key are placed in any order.
    One shuffle and one sort place the rows of groups of up to ``heavy`` rows.  A larger group
    is dealt out by ranges of its key first, so it never meets in one task, and the rows of its
    earlier ranges are added; the table of these counts has at most ``ranges + 1`` rows for
    each ``heavy`` rows of ``df`` and is broadcast."""
    sizes = df.groupBy(F.col(group_col).alias("_of")).agg(F.count(F.lit(1)).alias("_n")) \
        .where(F.col("_n") > heavy).select("_of", F.lit(True).alias("_heavy"))
    marked = df.join(F.broadcast(sizes), F.col(group_col).eqNullSafe(F.col("_of")), "left").drop("_of")
    key = F.col(order_col).cast("double")
    shares = [i / ranges for i in range(1, ranges)]
    bounds = marked.where("_heavy").agg(F.percentile_approx(key, shares, 10_000).alias("_bounds"))
    at = F.size(F.filter(F.coalesce("_bounds", F.array().cast("array<double>")), lambda b: b < key))
    dealt = marked.crossJoin(F.broadcast(bounds)).withColumn(  # one row
        "_range", F.when(F.col("_heavy").isNull(), 0).when(key.isNull(), -1).otherwise(at)).drop("_bounds")
    earlier = Window.partitionBy("_of").orderBy(F.col("_from").desc()).rowsBetween(
        Window.unboundedPreceding, -1)
    before = dealt.where("_heavy").groupBy(F.col(group_col).alias("_of"), F.col("_range").alias("_from")) \
        .agg(F.count(F.lit(1)).alias("_n")).select("_of", "_from", F.sum("_n").over(earlier).alias("_before"))
    inside = Window.partitionBy(group_col, "_range").orderBy(F.col(order_col).desc())
    return dealt.withColumn("_local", F.row_number().over(inside) - 1).join(
        F.broadcast(before), F.col("_heavy") & F.col(group_col).eqNullSafe(F.col("_of"))
        & (F.col("_range") == F.col("_from")), "left").select(
        *df.columns, (F.col("_local") + F.coalesce("_before", F.lit(0))).cast("bigint").alias(name))
