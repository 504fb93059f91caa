"""Ordered scans (ranks, running sums, quantiles) that survive hot groups.

A plain ``Window.partitionBy(group)`` puts a whole group into one task. Every scan here
therefore counts its groups first. While no group exceeds ``hot_rows`` the plain window is
used. Otherwise the input is materialised once, each hot group is cut into ordered slices,
every slice is ranked by its own task and shifted by the totals of the slices before it.
The cut points are broadcast only while there are few hot groups; else they are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import harmonic_number
from ..session import cut_lineage

HOT_ROWS = 5_000_000
SLICES = 64
# Above this, p values are merged before they are ordered, and a window of whole rows is not used.
ADJUST_ROWS = 500_000
BROADCAST_GROUPS = 4096


def has_hot_group(df: DataFrame, keys: list[str], hot_rows: int | None) -> bool:
    """Whether any group is larger than ``hot_rows``. ``None``: small by construction."""
    if hot_rows is None:
        return False
    sizes = df.select(*keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    top = sizes.agg(F.max("_n")).first()[0]
    return top is not None and top > hot_rows


def _sliced(df: DataFrame, keys: list[str], hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """Materialised input with ``_slice`` (0 in cold groups), and the hot keys.

    The cut points of a group are a sample with one row per hash slot, the one with the
    smallest hash: it depends on the data alone and is the same when a task runs again.
    """
    work = cut_lineage(df)
    sizes = work.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = sizes.where(F.col("_n") > hot_rows).select(*keys)
    few = hot.count() <= BROADCAST_GROUPS
    slot = F.pmod(F.xxhash64("_o"), F.lit(SLICES)).alias("_slot")
    sample = work.select(*keys, "_o").join(hot, keys, "left_semi").groupBy(*keys, slot).agg(
        F.min_by("_o", F.xxhash64(F.lit(7), F.col("_o"))).alias("_o"))
    cuts = sample.groupBy(*keys).agg(F.array_sort(F.collect_list("_o")).alias("_cuts"))
    below = F.size(F.filter("_cuts", lambda c: c < F.col("_o")))
    placed = work.join(F.broadcast(cuts) if few else cuts, keys, "left").withColumn(
        "_slice", F.when(F.col("_cuts").isNull(), 0).otherwise(below)).drop("_cuts")
    return placed, cuts.select(*keys)


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    rank: str | None = "rank",
    sums: dict[str, Column] | None = None,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Add a 1-based row number and inclusive running sums within ``keys``.

    ``order`` are ascending expressions that together must be unique inside a group.
    ``hot_rows=None`` states that groups are small by construction (a plain window).
    """
    sums = sums or {}
    work = df.withColumn("_o", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]))
    for name, value in sums.items():
        work = work.withColumn(f"_v_{name}", value)
    hot = has_hot_group(work, keys, hot_rows)
    part = list(keys)
    if hot:
        work, hot_keys = _sliced(work, keys, hot_rows)
        part.append("_slice")
    by = Window.partitionBy(*part).orderBy("_o")
    out = work.withColumn(rank, F.row_number().over(by).cast("long")) if rank else work
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for name in sums:
        out = out.withColumn(name, F.sum(f"_v_{name}").over(upto))
    if hot:
        totals = work.join(hot_keys, keys, "left_semi").groupBy(*part).agg(
            F.count(F.lit(1)).alias("_n"), *[F.sum(f"_v_{s}").alias(f"_t_{s}") for s in sums])
        before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        shift = totals.select(
            *part, F.sum("_n").over(before).alias("_off"),
            *[F.sum(f"_t_{s}").over(before).alias(f"_off_{s}") for s in sums])
        out = out.join(shift, part, "left")
        if rank:
            out = out.withColumn(rank, F.col(rank) + F.coalesce("_off", F.lit(0)))
        for s in sums:
            out = out.withColumn(s, F.col(s) + F.coalesce(f"_off_{s}", F.lit(0)))
        out = out.drop("_off", "_slice", *[f"_off_{s}" for s in sums])
    return out.drop("_o", *[f"_v_{s}" for s in sums])


def range_scan(df: DataFrame, keys: list[str], order: list[str], sums: list[str]) -> DataFrame:
    """Turn each of ``sums`` into its inclusive running sum within ``keys``, by the ``order`` columns.

    One range sort over all groups at once: a group may be any share of the rows, and no plan depends on its size. Rows that
    are equal in ``keys`` and ``order`` share a task, so the order should tell rows apart.
    """
    by = [*keys, *order]
    # Kept, as range bounds come from a sample and the runs are read twice.
    ranged = cut_lineage(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy(*keys, "_part").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select(*keys, "_part", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_off_{c}") for c in sums])
    upto = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = ranged.join(shift, [*keys, "_part"])
    for c in sums:
        run = run.withColumn(c, F.sum(c).over(upto) + F.col(f"_off_{c}"))
    return run.drop("_part", *[f"_off_{c}" for c in sums])


def average_rank(
    df: DataFrame, keys: list[str], value: str, rank: str = "rank", hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """Rank with ties averaged. Equal values are counted before anything is ordered."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    cum = ordered_scan(counts, keys, [F.col(value)], rank=None, sums={"_cum": F.col("_c")}, hot_rows=hot_rows)
    ranks = cum.select(*keys, value, (F.col("_cum") - (F.col("_c") - 1) / 2.0).alias(rank))
    return df.join(ranks, [*keys, value])


def group_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    wanted: dict[str, float],
    zeros: str | None = None,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Exact quantiles (linear interpolation between order statistics) of each group, all from one pass.

    ``wanted`` names an output column for each quantile. ``zeros`` names a column, constant per group, with the number of
    implicit zeros; the stored values must then be non-negative, so that the zeros rank before them.
    """
    z = F.col(zeros).cast("long") if zeros else F.lit(0).cast("long")
    work = df.select(*keys, F.col(value).alias("_v"), z.alias("_z"))
    if hot_rows is not None:
        work = cut_lineage(work)  # read several times
        if not has_hot_group(work, keys, hot_rows):
            hot_rows = None
        elif zeros is None:
            found = _bracketed_quantiles(work, keys, wanted, hot_rows)
            if found is not None:
                return found
    counts = work.groupBy(*keys, "_v").agg(
        F.count(F.lit(1)).alias("_c"), F.max("_z").alias("_z")
    )
    cum = ordered_scan(counts, keys, [F.col("_v")], rank=None, sums={"_cum": F.col("_c")}, hot_rows=hot_rows)
    total = counts.groupBy(*keys).agg((F.sum("_c") + F.max("_z")).alias("_n"))
    j = cum.join(total, keys)
    last = F.col("_cum") + F.col("_z")
    first = last - F.col("_c") + 1

    def pick(at: Column) -> Column:
        return F.coalesce(F.max(F.when((at >= first) & (at <= last), F.col("_v"))), F.lit(0.0))

    def place(q: float) -> Column:
        return (F.col("_n") - 1) * F.lit(float(q))

    ends = [c for k, q in enumerate(wanted.values()) for c in (
        pick(F.floor(place(q)) + 1).alias(f"_lo{k}"), pick(F.ceil(place(q)) + 1).alias(f"_hi{k}"))]
    picked = j.groupBy(*keys).agg(F.max("_n").alias("_n"), *ends)
    return picked.select(*keys, *[
        (F.col(f"_lo{k}") + (F.col(f"_hi{k}") - F.col(f"_lo{k}")) * (place(q) - F.floor(place(q)))).alias(out)
        for k, (out, q) in enumerate(wanted.items())])


# Half the width of a bracket, as a share of the group, and the accuracy of its ends: well inside of it.
BRACKET = 5e-4
ACCURACY = 10_000


def _bracketed_quantiles(work: DataFrame, keys: list[str], wanted: dict[str, float], hot_rows: int) -> DataFrame | None:
    """Exact quantiles of few, large groups without ordering them. None: a bracket missed or there are many groups.

    Approximate quantiles bracket the order statistics; one more pass counts what lies below each bracket and gives its
    values, which alone are ordered. The counts tell whether the wanted places lie inside.
    """
    shares = [min(1.0, max(0.0, q + d)) for q in wanted.values() for d in (-BRACKET, BRACKET)]
    ends = cut_lineage(work.groupBy(*keys).agg(F.percentile_approx("_v", shares, ACCURACY).alias("_e")))
    if ends.count() > BROADCAST_GROUPS:
        return None
    near = work.join(F.broadcast(ends), keys)
    v = F.col("_v")
    low, high = ([F.col("_e")[2 * k + d] for k in range(len(wanted))] for d in (0, 1))
    below = cut_lineage(near.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[
        F.count_if(v.isNull() | (v < x)).alias(f"_b{k}") for k, x in enumerate(low)]))
    inside = near.select(*keys, v, F.explode(F.array_compact(F.array(*[
        F.when((v >= a) & (v <= b), F.lit(k)) for k, (a, b) in enumerate(zip(low, high, strict=True))]))).alias("_k"))
    counts = cut_lineage(inside.groupBy(*keys, "_k", "_v").agg(F.count(F.lit(1)).alias("_c")))
    cum = ordered_scan(counts, [*keys, "_k"], [v], rank=None, sums={"_cum": F.col("_c")}, hot_rows=hot_rows)
    j = cum.join(F.broadcast(below), keys)
    picks = []
    for k, q in enumerate(wanted.values()):
        last = F.col("_cum") + F.col(f"_b{k}")
        place = (F.col("_n") - 1) * F.lit(float(q))
        for name, at in (("lo", F.floor(place) + 1), ("hi", F.ceil(place) + 1)):
            here = (F.col("_k") == k) & (at > last - F.col("_c")) & (at <= last)
            picks.append(F.max(F.when(here, v)).alias(f"_{name}{k}"))
    picked = cut_lineage(j.groupBy(*keys).agg(F.max("_n").alias("_n"), *picks))
    missed = F.greatest(*[F.col(c).isNull() for c in picked.columns if c not in (*keys, "_n")])
    if picked.count() < ends.count() or picked.where(missed).count():
        return None
    out = []
    for k, (name, q) in enumerate(wanted.items()):
        place = (F.col("_n") - 1) * F.lit(float(q))
        out.append((F.col(f"_lo{k}") + (F.col(f"_hi{k}") - F.col(f"_lo{k}")) * (place - F.floor(place))).alias(name))
    return picked.select(*keys, *out)


def group_quantile(
    df: DataFrame,
    keys: list[str],
    value: str,
    q: float,
    out: str,
    zeros: str | None = None,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """One exact quantile of each group."""
    return group_quantiles(df, keys, value, {out: q}, zeros, hot_rows)


def adjust_p(
    df: DataFrame,
    keys: list[str],
    p: str,
    out: str,
    method: str = "BH",
    hot_rows: int | None = ADJUST_ROWS,
) -> DataFrame:
    """p.adjust over the non-null p values of each group; NULL stays NULL.

    Methods BH (fdr), BY, holm, hochberg, hommel, bonferroni, none. Equal p values are
    merged before ordering, so a spike of ones costs one row.
    """
    if method == "none":
        return df.withColumn(out, F.col(p))
    if method not in ("BH", "fdr", "BY", "holm", "hochberg", "hommel", "bonferroni"):
        raise ValueError(f"unknown adjustment method: {method}")
    valid = F.col(p).isNotNull() & ~F.isnan(F.col(p).cast("double"))
    if method not in ("hommel", "bonferroni") and not has_hot_group(df, keys, hot_rows):
        return _adjust_in_windows(df.withColumn("_p", F.when(valid, F.col(p))), keys, out, method)
    known = df.where(valid)
    counts = known.groupBy(*keys, p).agg(F.count(F.lit(1)).alias("_c"))
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("_m"))
    if method == "bonferroni":
        adj = counts.join(totals, keys).select(*keys, p, F.least(F.lit(1.0), F.col(p) * F.col("_m")).alias(out))
        return df.join(adj, [*keys, p], "left")
    if method == "hommel":
        return df.join(_hommel(counts, keys, p, out), [*keys, p], "left")
    counts = cut_lineage(counts)
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("_m"))
    limit = hot_rows if has_hot_group(counts, keys, hot_rows) else None
    cum = ordered_scan(counts, keys, [F.col(p)], rank=None, sums={"_cum": F.col("_c")}, hot_rows=limit)
    j = cum.join(totals, keys)
    m, c = F.col("_m"), F.col("_cum")
    if method in ("BH", "fdr"):
        raw = F.col(p) * m / c
    elif method == "BY":
        raw = F.col(p) * m / c * harmonic_number(m)
    elif method == "hochberg":
        raw = F.col(p) * (m - c + 1)
    else:
        raw = F.col(p) * (m - c + F.col("_c"))
    j = j.withColumn("_raw", raw)
    descending = method != "holm"
    run = _running_extreme(j, keys, p, "_raw", descending, limit)
    adj = run.select(*keys, p, F.least(F.lit(1.0), F.col("_ext")).alias(out))
    return df.join(adj, [*keys, p], "left")


def _adjust_in_windows(df: DataFrame, keys: list[str], out: str, method: str) -> DataFrame:
    """The step-up and step-down rules in one ordered pass over each group."""
    group = Window.partitionBy(*keys)
    m = F.count("_p").over(group)
    p = F.col("_p")
    if method == "holm":
        w = group.orderBy(p.asc_nulls_last())
        at = F.row_number().over(w)
        raw, fold = p * (m - at + 1), F.max
    else:
        w = group.orderBy(p.desc_nulls_last())
        from_top = F.row_number().over(w)
        at = m - from_top + 1
        fold = F.min
        raw = p * from_top if method == "hochberg" else p * m / at
        if method == "BY":
            raw = raw * harmonic_number(m)
    run = fold("_raw").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    adjusted = df.withColumn("_raw", F.when(p.isNotNull(), raw)).withColumn(
        out, F.when(p.isNotNull(), F.least(F.lit(1.0), run)))
    return adjusted.drop("_raw", "_p")


def _running_extreme(
    df: DataFrame, keys: list[str], by: str, value: str, descending: bool, hot_rows: int | None
) -> DataFrame:
    """Running minimum from the largest ``by`` down, or running maximum from the smallest up."""
    order = -F.col(by) if descending else F.col(by)
    agg = F.min if descending else F.max
    work = df.withColumn("_o", F.struct(order.alias("k0")))
    part = list(keys)
    if hot_rows is not None:
        work, hot_keys = _sliced(work, keys, hot_rows)
        part.append("_slice")
    w = Window.partitionBy(*part).orderBy("_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = work.withColumn("_ext", agg(value).over(w))
    if hot_rows is not None:
        totals = work.join(hot_keys, keys, "left_semi").groupBy(*part).agg(agg(value).alias("_t"))
        before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        shift = totals.select(*part, agg("_t").over(before).alias("_off"))
        both = F.least if descending else F.greatest
        out = out.join(shift, part, "left").withColumn("_ext", both("_ext", "_off")).drop("_off", "_slice")
    return out.drop("_o")


def hommel_values(v):
    """Hommel's adjustment of ascending p values in O(m log m).

    The level up to which a hypothesis set of size i is kept is i times the least slope from the point (m - i, 0) to the
    points (rank, p) right of it, a tangent to their lower hull; the adjusted p is the least level at which p leaves.
    """
    import numpy as np

    m = len(v)
    level = np.zeros(m + 2)
    hull_x, hull_y = [], []  # lower hull of the points seen so far, leftmost last
    for s in range(m - 1, -1, -1):
        x, y = s + 1, v[s]
        while len(hull_x) > 1 and (hull_y[-1] - y) * (hull_x[-2] - hull_x[-1]) >= (hull_y[-2] - hull_y[-1]) * (hull_x[-1] - x):
            hull_x.pop()
            hull_y.pop()
        hull_x.append(x)
        hull_y.append(y)
        low, high = 0, len(hull_x) - 1  # the slope from (s, 0) falls towards the tangent point
        while low < high:
            mid = (low + high + 1) // 2
            if hull_y[mid] * (hull_x[mid - 1] - s) <= hull_y[mid - 1] * (hull_x[mid] - s):
                low = mid
            else:
                high = mid - 1
        level[m - s] = (m - s) * hull_y[low] / (hull_x[low] - s)
    most = np.maximum.accumulate(level[::-1])[::-1]
    sizes = np.arange(1, m + 1)
    at = np.searchsorted(-(most[2:] / sizes), -np.asarray(v), "left") + 1
    return np.minimum(1.0, np.minimum(at * v, most[at]))


def _hommel(counts: DataFrame, keys: list[str], p: str, out: str) -> DataFrame:
    """Hommel's adjustment of distinct p values with their counts, one group per task."""
    import pandas as pd
    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([f for f in counts.schema.fields if f.name in [*keys, p]] + [StructField(out, DoubleType())])

    def adjust(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values(p)
        times = pdf["_c"].to_numpy(int)
        pdf[out] = hommel_values(np.repeat(pdf[p].to_numpy(float), times))[np.cumsum(times) - 1]
        return pdf[[*keys, p, out]]

    return counts.groupBy(*keys).applyInPandas(adjust, schema)
