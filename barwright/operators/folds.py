"""Linear recurrences without recursion.

y_t = a_t y_(t-1) + b_t with 0 <= a_t <= 1 is exp(L_t) * sum over i<=t of b_i exp(-L_i), L the running sum of log a. A row with
a = 0 starts a segment of its own. The scale is kept in range by cutting a segment wherever L has fallen by SPAN; sums within a
span are carried over as many earlier spans as have a weight above zero in a double, so nothing that a double can show is cut
off, for any rates. Inputs may be as large as 1e200.
"""

import math

from pyspark.sql import functions as F

from barwright.functions.numeric import col, safe_div
from barwright.operators.windows import KEYS, ORDER, ordered, so_far

#: Fall of the log weight in a span, and earlier spans that are carried: exp(-4 * 200) is zero in a double.
SPAN, CARRIED = 200.0, 3


def _weighted(df, keys, order, fall, inputs):
    """Adds ``out`` = sum over earlier rows i and this one of input_i * exp(-(fall - fall_i)) for ``inputs`` = {out: column}.

    ``fall`` is a column that does not decrease in the order of ``keys``.
    """
    df = df.withColumn("_span", F.floor(col(fall) / SPAN))
    inside = so_far((*keys, "_span"), order)
    scale = F.exp(col(fall) - SPAN * F.col("_span"))
    df = df.withColumns({f"_x_{out}": F.coalesce(col(c), F.lit(0.0)) * scale for out, c in inputs.items()})
    before = ordered(keys, ("_span",))
    df = df.withColumns({f"_o_{out}": F.sum(f"_x_{out}").over(inside) for out in inputs} | {
        f"_p{i}_{out}": F.sum(f"_x_{out}").over(before.rangeBetween(-i, -i)) for i in range(1, CARRIED + 1) for out in inputs})

    def whole(out):
        carried = sum((F.coalesce(F.col(f"_p{i}_{out}"), F.lit(0.0)) * math.exp(-SPAN * i) for i in range(2, CARRIED + 1)),
                      F.coalesce(F.col(f"_p1_{out}"), F.lit(0.0)) * math.exp(-SPAN))
        return (F.col(f"_o_{out}") + carried) / scale
    df = df.withColumns({out: whole(out) for out in inputs})
    return df.drop("_span", *[f"_{k}_{out}" for k in ("x", "o", *[f"p{i}" for i in range(1, CARRIED + 1)]) for out in inputs])


def decayed_sums(df, series, keys=KEYS, order=ORDER):
    """Adds each ``out`` = sum of a^(age in rows) * c for ``series`` = {out: (c, a)}, 0 <= a <= 1.

    Null inputs add nothing but still age. Series of one rate share their passes.
    """
    df = df.withColumn("_i", F.row_number().over(ordered(keys, order)) - 1)
    for rate in sorted({a for _, a in series.values()}):
        inputs = {out: c for out, (c, a) in series.items() if a == rate}
        if rate == 0:
            df = df.withColumns({out: F.coalesce(col(c), F.lit(0.0)) for out, c in inputs.items()})
        else:
            df = _weighted(df.withColumn("_fall", F.col("_i") * -math.log(rate)), keys, order, "_fall", inputs).drop("_fall")
    return df.drop("_i")


def linear_scan(df, keep, add, out, keys, order, product=None):
    """Adds ``out``: y = keep * y_before + add per row (keep between 0 and 1, y before the first row 0).

    ``product`` names a column for the weight that a value before the first row would still have.
    """
    w = so_far(keys, order)
    df = df.withColumn("_seg", F.sum(F.when(col(keep) == 0, 1).otherwise(0)).over(w))
    fall = F.sum(F.when(col(keep) > 0, -F.log(col(keep))).otherwise(0.0)).over(so_far((*keys, "_seg"), order))
    df = _weighted(df.withColumn("_fall", fall), (*keys, "_seg"), order, "_fall", {out: add})
    if product:
        df = df.withColumn(product, F.when(F.col("_seg") == 0, F.exp(-F.col("_fall"))).otherwise(0.0))
    return df.drop("_seg", "_fall")


def emas(df, c, outs, keys=KEYS, order=ORDER):
    """Recursive EMAs of one column seeded with the first value, k = 2/(n+1); ``outs`` = {name: n}."""
    first = F.row_number().over(ordered(keys, order)) == 1
    df = df.withColumn("_first", first)
    df = df.withColumns({f"_x_{out}": F.when(F.col("_first"), col(c)).otherwise(col(c) * (2.0 / (n + 1))) for out, n in outs.items()})
    df = decayed_sums(df, {out: (f"_x_{out}", 1 - 2.0 / (n + 1)) for out, n in outs.items()}, keys, order)
    return df.drop("_first", *[f"_x_{out}" for out in outs])


def ema(df, c, n, out=None, keys=KEYS, order=ORDER):
    return emas(df, c, {out or f"ema_{n}": n}, keys, order)


def ewms(df, n, outs, keys=KEYS, order=ORDER):
    """Bias-adjusted exponential means, ``outs`` = {name: column}; null before a column's first value,
    nulls age the weights."""
    a = 1 - 2.0 / (n + 1)
    df = df.withColumns({f"_w_{out}": F.when(col(c).isNotNull(), 1.0).otherwise(0.0) for out, c in outs.items()})
    series = {}
    for out, c in outs.items():
        series[f"_num_{out}"], series[f"_den_{out}"] = (c, a), (f"_w_{out}", a)
    df = decayed_sums(df, series, keys, order)
    df = df.withColumns({out: safe_div(f"_num_{out}", f"_den_{out}") for out in outs})
    return df.drop(*series, *[f"_w_{out}" for out in outs])


def adx(df, n=14):
    """Directional indicators and their smoothed index."""
    w = ordered()
    before = F.lag("close").over(w)
    up, down = F.col("high") - F.lag("high").over(w), F.lag("low").over(w) - F.col("low")
    df = df.withColumns({
        "_tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)),
        "_pdm": F.when((up > down) & (up > 0), up).otherwise(0.0),
        "_mdm": F.when((down > up) & (down > 0), down).otherwise(0.0)})
    df = ewms(df, n, {c + "_s": c for c in ("_tr", "_pdm", "_mdm")})
    df = df.withColumns({"plus_di": 100 * safe_div("_pdm_s", "_tr_s"), "minus_di": 100 * safe_div("_mdm_s", "_tr_s")})
    gap, total = F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di")
    df = ewms(df.withColumn("_dx", safe_div(100 * gap, total)), n, {"adx": "_dx"})
    return df.drop("_tr", "_pdm", "_mdm", "_tr_s", "_pdm_s", "_mdm_s", "_dx")


def macd(df, fast=12, slow=26, signal=7, keys=KEYS, order=ORDER):
    """Line, signal and histogram; null until slow+signal closes exist."""
    df = emas(df, "close", {"_f": fast, "_s": slow}, keys, order)
    df = df.withColumn("_line", F.col("_f") - F.col("_s"))
    df = ema(df, "_line", signal, "_sig", keys, order)
    ready = F.count("close").over(so_far(keys, order)) >= slow + signal
    return df.withColumns({
        "macd": F.when(ready, F.col("_line")), "macd_signal": F.when(ready, F.col("_sig")),
        "macd_hist": F.when(ready, F.col("_line") - F.col("_sig"))}).drop("_f", "_s", "_line", "_sig")
