"""Point-in-time panels and their statistics.

A panel has one row per (symbol, period); the latest n periods of a symbol (n at most a dozen)
fit in one small array, newest first, on which every statistic is a JVM-side array expression.
"""

from pyspark.sql import Window as W, functions as F

from barwright.functions.numeric import col, safe_div


def latest_periods(panel, as_of, n):
    """Rows known at ``as_of``, newest n per symbol."""
    w = W.partitionBy("symbol").orderBy(F.desc("report_period"))
    known = panel.filter(F.col("report_period") <= F.lit(as_of).cast("date"))
    return known.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def profile(panel, as_of, n):
    """One row per symbol: its latest n periods as ``_p``, newest first, and their number ``_n``."""
    latest = latest_periods(panel, as_of, n)
    items = [c for c in latest.columns if c != "symbol"]
    row = F.struct("report_period", *[c for c in items if c != "report_period"])
    return latest.groupBy("symbol").agg(F.sort_array(F.collect_list(row), asc=False).alias("_p"), F.count(F.lit(1)).alias("_n"))


def now(item):
    """The newest period's value, which may be null."""
    return F.get(F.col("_p"), F.lit(0))[item]


def series(item, nonzero=False):
    """Known values, newest first."""
    s = F.filter(F.transform("_p", lambda x: x[item]), lambda v: v.isNotNull())
    return F.filter(s, lambda v: v != 0) if nonzero else s


def first(a):
    return F.get(a, F.lit(0))


def last(a):
    return F.try_element_at(a, F.lit(-1))


def total(a):
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def mean(a):
    return safe_div(total(a), F.size(a))


def count_if(a, pred):
    return F.size(F.filter(a, pred))


def majority(a, pred):
    """More than half of the known values meet the predicate."""
    return (F.size(a) > 0) & (count_if(a, pred) >= F.floor(F.size(a) / 2) + 1)


def total_growth(a):
    """Newest against oldest, over |oldest|."""
    return F.when(F.size(a) >= 2, safe_div(first(a) - last(a), F.abs(last(a))))


def cagr(a):
    """Compound rate from oldest to newest; null unless both are positive."""
    ok = (F.size(a) >= 2) & (last(a) > 0) & (first(a) > 0)
    return F.when(ok, F.pow(first(a) / last(a), 1.0 / (F.size(a) - 1)) - 1)


def std(a, sample=False):
    m = mean(a)
    ss = F.aggregate(a, F.lit(0.0), lambda s, v: s + (v - m) * (v - m))
    return F.sqrt(safe_div(ss, F.size(a) - (1 if sample else 0)))


def stability(a, kind="cv"):
    """cv: population std / |mean|; std: population std; mad: mean absolute deviation; capped: sample cv up to 1."""
    m = mean(a)
    if kind == "cv":
        return safe_div(std(a), F.abs(m))
    if kind == "std":
        return std(a)
    if kind == "mad":
        return safe_div(F.aggregate(a, F.lit(0.0), lambda s, v: s + F.abs(v - m)), F.size(a))
    return F.when(m > 0, F.least(safe_div(std(a, True), m), F.lit(1.0)))


def trend_slope(a):
    """Least-squares slope of the newest-first values on 0, 1, 2, ...: positive means falling over time."""
    n = F.size(a)
    idx = F.transform(a, lambda v, i: v * i)
    sx, sxx = n * (n - 1) / 2, (n - 1) * n * (2 * n - 1) / 6
    return F.when(n >= 2, safe_div(n * total(idx) - sx * total(a), n * sxx - sx * sx)).otherwise(0.0)


def recent_mean(a, k):
    return mean(F.slice(a, 1, k))


def recent_vs_old(a, k=3):
    """Mean of the newest k, and of the oldest k if there are 2k values, else the oldest value."""
    old = F.when(F.size(a) >= 2 * k, mean(F.slice(F.reverse(a), 1, k))).otherwise(last(a))
    return recent_mean(a, k), old


def median(a):
    s = F.array_sort(a)
    n = F.size(s)
    hi, lo = F.get(s, F.floor(n / 2).cast("int")), F.get(s, F.floor((n - 1) / 2).cast("int"))
    return (hi + lo) / 2


def upper_median(a):
    return F.get(F.array_sort(a), F.floor(F.size(a) / 2).cast("int"))


def growth_series(a):
    """Period growth over |previous|, newest first."""
    prev = F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))
    return F.filter(F.zip_with(F.slice(a, 1, F.size(prev)), prev, lambda c, p: F.try_divide(c - p, F.abs(p))), lambda v: v.isNotNull())


def acceleration(a):
    g = growth_series(a)
    return F.when(F.size(g) >= 2, first(g) - last(g))


def consistency(a, strict=True):
    """Share of adjacent periods in which the newer value is larger, and whether all are."""
    prev = F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))
    up = F.zip_with(F.slice(a, 1, F.size(prev)), prev, lambda c, p: (c > p) if strict else (c >= p))
    n = F.size(prev)
    k = F.size(F.filter(up, lambda v: v))
    return k, n, F.when(n > 0, k == n).otherwise(F.lit(False))


def pv(base, growth, rate, years):
    """Present value of a base growing for ``years`` years."""
    growth, rate = (x if not isinstance(x, float) else F.lit(x) for x in (growth, rate))
    return F.aggregate(F.sequence(F.lit(1), F.lit(years)), F.lit(0.0), lambda s, y: s + base * F.pow(1 + growth, y) / F.pow(1 + rate, y))
