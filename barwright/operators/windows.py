"""Indicators over bars, one shuffle by symbol and one sort by time.

Frames here hold at most one row per (symbol, interval), so a window group is bounded by
the calendar. Indicators that share a spec are merged by Catalyst into one Window stage.
A rolling(n) value is null until n non-null inputs exist.
"""

import math

from pyspark.sql import Window as W, functions as F

from barwright.functions.numeric import col, safe_div

KEYS = ("symbol",)
ORDER = ("ts",)


def ordered(keys=KEYS, order=ORDER):
    return W.partitionBy(*keys).orderBy(*order)


def last_n(n, keys=KEYS, order=ORDER):
    return ordered(keys, order).rowsBetween(-(n - 1), 0)


def so_far(keys=KEYS, order=ORDER):
    return ordered(keys, order).rowsBetween(W.unboundedPreceding, 0)


def rolling(agg, c, n, keys=KEYS, order=ORDER):
    w = last_n(n, keys, order)
    return F.when(F.count(col(c)).over(w) == n, agg(col(c)).over(w))


def returns(df, keys=KEYS, order=ORDER, out="ret"):
    if out in df.columns:
        return df
    prev = F.lag("close").over(ordered(keys, order))
    return df.withColumn(out, safe_div("close", prev) - 1)


def prev_close(df, keys=KEYS, order=ORDER):
    df = df.withColumn("prev_close", F.lag("close").over(ordered(keys, order)))
    return df.withColumn("change_pct", safe_div(F.col("close") - F.col("prev_close"), "prev_close") * 100)


def sma(df, n, c="close", out=None):
    return df.withColumn(out or f"sma_{n}", rolling(F.avg, c, n))


def zscore(df, n=50, out="zscore"):
    gap = F.col("close") - rolling(F.avg, "close", n)
    return df.withColumn(out, safe_div(gap, rolling(F.stddev_samp, "close", n)))


def bollinger(df, n=20, k=2.0):
    mid, sd = rolling(F.avg, "close", n), rolling(F.stddev_samp, "close", n)
    df = df.withColumns({"bb_upper": mid + sd * k, "bb_lower": mid - sd * k})
    return df.withColumn("pct_b", safe_div(F.col("close") - F.col("bb_lower"), F.col("bb_upper") - F.col("bb_lower")))


def rsi(df, n=14, variant="rolling", out=None, keys=KEYS, order=ORDER, eps=0.0):
    """Simple-mean RSI.

    ``rolling``: the first move counts as 0, so a value exists from bar n; 0/0 is null.
    ``strict``: needs n+1 closes, no losses (at most ``eps``) gives 100, rounded to 2 digits.
    """
    move = F.col("close") - F.lag("close").over(ordered(keys, order))
    df = df.withColumn("_move", F.coalesce(move, F.lit(0.0)) if variant == "rolling" else move)
    # greatest() skips nulls: keep the first strict move unknown
    up = F.when(F.col("_move").isNotNull(), F.greatest("_move", F.lit(0.0)))
    down = F.when(F.col("_move").isNotNull(), F.greatest(-F.col("_move"), F.lit(0.0)))
    gain, loss = rolling(F.avg, up, n, keys, order), rolling(F.avg, down, n, keys, order)
    index = 100 - 100 / (1 + safe_div(gain, loss))
    if variant == "rolling":
        value = F.when((loss == 0) & (gain > 0), F.lit(100.0)).otherwise(index)
    else:
        value = F.when(gain.isNull(), None).when(loss <= eps, F.lit(100.0)).otherwise(F.bround(index, 2))
    return df.withColumn(out or f"rsi_{n}", value).drop("_move")


def true_range(df, out="tr"):
    before = F.lag("close").over(ordered())
    return df.withColumn(out, F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def atr(df, n=14):
    df = true_range(df).withColumn("atr", rolling(F.avg, "tr", n))
    return df.withColumn("atr_ratio", safe_div("atr", "close"))


def momentum(df):
    df = returns(df).withColumns({
        "mom_1m": rolling(F.sum, "ret", 21), "mom_3m": rolling(F.sum, "ret", 63), "mom_6m": rolling(F.sum, "ret", 126),
        "volume_momentum": safe_div("volume", rolling(F.avg, "volume", 21))})
    return df.withColumn("momentum_score", 0.4 * F.col("mom_1m") + 0.3 * F.col("mom_3m") + 0.3 * F.col("mom_6m"))


def vol_regime(df):
    df = returns(df).withColumn("hist_vol", rolling(F.stddev_samp, "ret", 21) * math.sqrt(252))
    mean = rolling(F.avg, "hist_vol", 63)
    return df.withColumns({
        "vol_regime": safe_div("hist_vol", mean),
        "vol_z": safe_div(F.col("hist_vol") - mean, rolling(F.stddev_samp, "hist_vol", 63))})


def rolling_moments(df, n=63):
    """Bias-corrected sample skewness and excess kurtosis of returns over n bars."""
    df = returns(df)
    g1, g2 = rolling(F.skewness, "ret", n), rolling(F.kurtosis, "ret", n)
    return df.withColumns({
        "skew": g1 * (math.sqrt(n * (n - 1)) / (n - 2)), "kurt": ((n + 1) * g2 + 6) * ((n - 1) / ((n - 2) * (n - 3)))})


def roc(df, n=10, out=None):
    before = F.lag("close", n).over(ordered())
    return df.withColumn(out or f"roc_{n}", safe_div(F.col("close") - before, before) * 100)


def volume_ratio(df, short=5, long=20):
    return df.withColumn("volume_ratio", safe_div(rolling(F.avg, "volume", short), rolling(F.avg, "volume", long)))


def recent_range(df, n=10, keys=KEYS, order=ORDER):
    w = last_n(n, keys, order)
    return df.withColumn("recent_high", F.max("high").over(w)).withColumn("recent_low", F.min("low").over(w))


def vol_percentile(df, n=30):
    """Rolling n-bar volatility of returns, per bar."""
    return returns(df).withColumn("roll_vol", rolling(F.stddev_samp, "ret", n))


def drawdown(df, value="value", keys=("account",), order=("date",)):
    df = df.withColumn("peak", F.max(value).over(so_far(keys, order)))
    return df.withColumn("drawdown", safe_div(F.col(value) - F.col("peak"), "peak"))


def session_running(df, avg_volume=None):
    """State of the session up to each bar. ``avg_volume`` names a prior daily mean, if any."""
    keys = ("symbol", "session")
    w = so_far(keys)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    volume = F.sum("volume").over(w)
    df = df.withColumns({
        "bars_so_far": F.count(F.lit(1)).over(w), "day_open": F.first("open").over(w), "day_high": F.max("high").over(w),
        "day_low": F.min("low").over(w), "cum_volume": volume,
        "vwap": F.when(volume >= 1, safe_div(F.sum(typical * F.col("volume")).over(w), volume))})
    df = df.withColumn("price_vs_vwap_pct", F.when(F.col("vwap") > 0, safe_div(F.col("close") - F.col("vwap"), "vwap") * 100))
    if avg_volume:
        df = df.withColumn("cum_volume_ratio", F.when(F.col(avg_volume) > 0, safe_div("cum_volume", avg_volume)))
    return df


def regime_of(range_pct, change_pct):
    return (
        F.when(change_pct.isNull(), "unknown").when(range_pct > 2.5, "volatile")
        .when(change_pct > 0.5, "trending_up").when(change_pct < -0.5, "trending_down").otherwise("range_bound")
    )


LAGS = range(2, 20)


def hurst_moves(df, lags=LAGS):
    """The k-bar differences a Hurst estimate is made of."""
    return df.withColumns({f"_d{k}": F.col("close") - F.lag("close", k).over(ordered()) for k in lags})


def hurst_aggs(lags=LAGS):
    return [F.count("close").alias("_n"), *[F.sqrt(F.stddev_pop(f"_d{k}")).alias(f"_t{k}") for k in lags]]


def hurst_value(lags=LAGS):
    """Slope of ln sqrt(std of k-bar differences) on ln k: the lags are fixed, so the regression is a
    fixed linear combination of ln(tau); 0.5 without enough history."""
    xs = [math.log(k) for k in lags]
    mean = sum(xs) / len(xs)
    sxx = sum((x - mean) ** 2 for x in xs)
    slope = sum((F.lit((x - mean) / sxx) * F.log(F.greatest(F.col(f"_t{k}"), F.lit(1e-8))) for k, x in zip(lags, xs)), F.lit(0.0))
    return F.when(F.col("_n") > max(lags) + 1, slope).otherwise(F.lit(0.5))


def hurst(df, lags=LAGS):
    """Hurst exponent per symbol over its whole history."""
    return hurst_moves(df, lags).groupBy("symbol").agg(*hurst_aggs(lags)).select("symbol", hurst_value(lags).alias("hurst"))
