"""As-of, context and merge joins."""

from functools import reduce

from pyspark.sql import Window as W, functions as F

from barwright.functions.numeric import safe_div
from barwright.operators import windows as win


def business_days(df, start, end, out="date"):
    """Mon-Fri days between two date columns of each row of ``df`` (no holidays)."""
    d = df.select("*", F.explode(F.sequence(start, end)).alias(out))
    return d.filter(~F.dayofweek(out).isin(1, 7))


def last_business_days(df, end, n, out="date"):
    """The last n Mon-Fri days up to a date column: n days span at most 7*(n/5)+7 calendar days."""
    back = 7 * (n // 5) + 7
    d = df.select("*", F.explode(F.sequence(F.date_sub(end, back), F.col(end))).alias(out)).filter(~F.dayofweek(out).isin(1, 7))
    keys = [c for c in df.columns]
    r = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(out)))
    return d.withColumn("_r", r).filter(F.col("_r") <= n).drop("_r")


def price_asof_day(dates, bars, keys=()):
    """Last close within [date-1, date]; a date on which any symbol lacks one is dropped whole.

    Each bar offers itself to its own day and the next, so the range join becomes an equi-join.
    """
    offer = bars.select(*keys, "symbol", "ts", "close", F.explode(F.array(F.col("ts"), F.date_add("ts", 1))).alias("date"))
    px = offer.join(dates, [*keys, "date"], "left_semi").groupBy(*keys, "date", "symbol").agg(F.max_by("close", "ts").alias("price"))
    wanted = bars.select(*keys, "symbol").distinct()
    need = wanted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_need")) if keys else None
    have = px.groupBy(*keys, "date").agg(F.count(F.lit(1)).alias("_have"))
    full = have.join(need, list(keys)) if keys else have.withColumn("_need", wanted.agg(F.count(F.lit(1))).scalar())
    return px.join(full.filter(F.col("_have") == F.col("_need")).select(*keys, "date"), [*keys, "date"], "left_semi")


def asof_join(left, right, by, on, cols, block="month"):
    """Latest right row at or before each left row.

    Both sides in one order carry the last right row forward, in two levels: within a block of a key (``block`` is a unit of date_trunc; choose one that
    holds a bounded number of rows), then over the blocks' last rows. Every row passes once, however dense a key is, and a hot key spreads
    over its blocks. Null keys match nothing.
    """
    by = list(by)
    unit = F.date_trunc(block, F.col(on).cast("timestamp"))
    known = [F.col(c).isNotNull() for c in (*by, on)]
    r = right.select(*by, F.col(on), F.struct(F.col(on).alias("_on"), *cols).alias("_r")).filter(reduce(lambda x, y: x & y, known)).withColumn("_block", unit)
    last = r.groupBy(*by, "_block").agg(F.max_by("_r", on).alias("_r"))
    both = left.select(F.struct(*left.columns).alias("_l"), *by, on).withColumn("_block", unit).unionByName(r, allowMissingColumns=True)
    within = W.partitionBy(*by, "_block").orderBy(on, F.col("_l").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumn("_in", F.last("_r", ignorenulls=True).over(within)).filter(F.col("_l").isNotNull())
    # what is carried into a left row's block is the last row of the newest right block before it
    blocks = both.select(*by, "_block").distinct().withColumn("_seen", F.lit(1)).unionByName(last.withColumnRenamed("_r", "_end"), allowMissingColumns=True)
    before = W.partitionBy(*by).orderBy("_block", F.col("_seen").isNull()).rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("_past", F.last("_end", ignorenulls=True).over(before)).filter(F.col("_seen").isNotNull()).drop("_seen", "_end")
    out = both.join(blocks, [*by, "_block"], "left").withColumn("_r", F.coalesce("_in", "_past"))
    return out.select("_l.*", F.col("_r._on").alias(f"{on}_right"), *[F.col(f"_r.{c}").alias(c) for c in cols])


def daily_context(bars):
    """Previous close, and the mean volume of up to 20 earlier days once there are two."""
    w = win.ordered()
    before = w.rowsBetween(-20, -1)
    mean = F.when(F.count("volume").over(before) >= 2, F.avg("volume").over(before))
    return bars.withColumn("prev_close", F.lag("close").over(w)).withColumn("avg_volume_20d", mean)


def running_regime(bars, anchor, second):
    """Market state at every bar time of a session, from the anchors' bars so far.

    The anchors have at most one row per slot; their state is carried forward over the session's
    slots, so the as-of becomes a window over one session's slots and an equi-join after it.
    """
    a = win.session_running(bars.filter(F.col("symbol").isin(anchor, second)))

    def of(sym, c):
        return F.max(F.when(F.col("symbol") == sym, F.col(c)))

    at = a.groupBy("session", "ts").agg(
        *[of(anchor, c).alias(f"_a_{c}") for c in ("day_open", "day_high", "day_low", "close")],
        *[of(second, c).alias(f"_b_{c}") for c in ("day_open", "close")])
    slots = bars.select("session", "ts").distinct().join(at, ["session", "ts"], "left")
    w = W.partitionBy("session").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    slots = slots.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in slots.columns if c.startswith("_")})
    chg = safe_div(F.col("_a_close") - F.col("_a_day_open"), "_a_day_open") * 100
    rng = safe_div(F.col("_a_day_high") - F.col("_a_day_low"), "_a_day_open") * 100
    known = F.col("_a_close").isNotNull()
    q = safe_div(F.col("_b_close") - F.col("_b_day_open"), "_b_day_open") * 100
    zero = F.lit(0.0)
    return slots.select(
        "session", "ts", F.when(known, win.regime_of(F.coalesce(rng, zero), F.coalesce(chg, zero))).otherwise("unknown").alias("regime"),
        F.coalesce(chg, zero).alias("spy_change_pct"), F.when(known, F.coalesce(q, zero)).otherwise(0.0).alias("qqq_change_pct"))


def with_market_context(bars, anchor, second):
    """Every non-anchor bar with the market state at its time."""
    others = bars.filter(~F.col("symbol").isin(anchor, second))
    return others.join(running_regime(bars, anchor, second), ["session", "ts"])


def market_cap(info, metrics):
    """Market cap per symbol; zero or missing falls back to the newest metrics row."""
    m = metrics.groupBy("symbol").agg(F.max_by("market_cap", "report_period").alias("_m"))
    j = info.join(m, "symbol", "left")
    return j.select("symbol", F.coalesce(F.nullif("market_cap", F.lit(0.0)), F.nullif("_m", F.lit(0.0))).alias("market_cap"))


def intraday_context(bars, news, labels, n_bars=6, n_news=3):
    """One row per symbol and session: summary, pre-market, previous session, last bars, headlines.

    Bars of a session and the top headlines are bounded lists; nothing else is collected.
    """
    from barwright.operators import aggs
    summary = aggs.session_summary(bars)
    daily = summary.select("symbol", F.col("session").alias("ts"), "close", "volume")
    ctx = daily_context(daily).select("symbol", F.col("ts").alias("session"), "prev_close", "avg_volume_20d")
    newest = F.row_number().over(W.partitionBy("symbol", "session").orderBy(F.desc("ts")))
    tail = bars.withColumn("_r", newest).filter(F.col("_r") <= n_bars).groupBy("symbol", "session").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("ts", "close"))), lambda x: x["close"]).alias("last_closes"))
    rank = F.row_number().over(W.partitionBy("symbol").orderBy("doc_id"))
    heads = news.withColumn("_r", rank).filter(F.col("_r") <= n_news).groupBy("symbol").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_r", "title"))), lambda x: x["title"]).alias("headlines"))
    return (
        summary.join(aggs.premarket_summary(bars), ["symbol", "session"], "left").join(ctx, ["symbol", "session"], "left")
        .join(tail, ["symbol", "session"], "left").join(heads, "symbol", "left").join(labels, "symbol", "left")
        .withColumn("change_1d_pct", safe_div(F.col("close") - F.col("prev_close"), "prev_close") * 100)
        .withColumn("volume_ratio", safe_div("volume", "avg_volume_20d"))
    )
