"""Grouped aggregates over bars, equity curves, trades, journals, news and signals.

All are plain grouped aggregates with map-side partials, or windows over frames that hold
one row per (key, day); a hot key shrinks before it is shuffled.
"""

import math

from pyspark.sql import Window as W, functions as F

from barwright.functions.numeric import clamp, col, safe_div
from barwright.operators import windows as win

DAYS = 252


def _cnt(cond):
    return F.count(F.when(cond, 1))


# -- bars -------------------------------------------------------------------------------

def vwap(bars, keys, min_volume=1.0, digits=None):
    """Volume-weighted typical price; null under ``min_volume`` (exclusive of zero)."""
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    agg = bars.groupBy(*keys).agg(F.sum(typical * F.col("volume")).alias("_pv"), F.sum("volume").alias("_v"))
    value = F.when(F.col("_v") >= min_volume, safe_div("_pv", "_v")) if min_volume else safe_div("_pv", "_v")
    return agg.select(*keys, (F.bround(value, digits) if digits is not None else value).alias("vwap"))


def session_summary(bars, keys=("symbol", "session")):
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    out = bars.groupBy(*keys).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"),
        safe_div(F.sum(typical * F.col("volume")), F.sum("volume")).alias("vwap"),
    )
    return out.withColumn("price_vs_vwap_pct", safe_div(F.col("close") - F.col("vwap"), "vwap") * 100)


def premarket_summary(bars, keys=("symbol", "session"), start=240, end=570):
    pre = bars.filter((F.col("et_minute") >= start) & (F.col("et_minute") < end))
    return pre.groupBy(*keys).agg(
        F.max("high").alias("premarket_high"), F.min("low").alias("premarket_low"), F.sum("volume").alias("premarket_volume"))


def benchmark_return(bars, start=None, end=None):
    """Buy-and-hold percent per symbol; a missing last close falls back to the last known."""
    b = bars
    if start is not None:
        b = b.filter(F.col("ts") >= F.lit(start))
    if end is not None:
        b = b.filter(F.col("ts") <= F.lit(end))
    g = b.groupBy("symbol").agg(
        F.min_by(F.struct("close"), "ts").alias("_f"),
        F.max_by("close", F.when(F.col("close").isNotNull(), F.col("ts"))).alias("_l"))
    return g.select("symbol", ((safe_div("_l", "_f.close") - 1) * 100).alias("return_pct"))


def return_pack(bars, as_of=None, days=90):
    """1/5/30-bar and 90-day changes, range and mean volume.

    The "5d" and "30d" bases are the 5th and 30th bars from the end; the "90d" fields cover the ``days`` calendar days up
    to ``as_of``, or to each symbol's last bar.
    """
    newest = W.partitionBy("symbol").orderBy(F.desc("ts"))
    b = known_at(bars, "ts", as_of)
    end = F.max("ts").over(W.partitionBy("symbol")) if as_of is None else F.lit(as_of).cast("date")
    b = b.withColumn("_r", F.row_number().over(newest)).withColumn("_in", F.col("ts") >= F.date_sub(end, days))

    def at(k):
        return F.max(F.when(F.col("_r") == k, F.col("close")))

    g = b.groupBy("symbol").agg(
        at(1).alias("current"), at(2).alias("_c2"), at(5).alias("_c5"), at(30).alias("_c30"),
        F.min_by("close", F.when(F.col("_in"), F.col("ts"))).alias("_c0"),
        F.max(F.when(F.col("_in"), F.col("high"))).alias("high_90d"), F.min(F.when(F.col("_in"), F.col("low"))).alias("low_90d"),
        F.avg(F.when(F.col("_r") <= 10, F.col("volume"))).alias("avg_volume_10d"),
        F.max(F.when(F.col("_r") == 1, F.col("volume"))).alias("volume"),
    )

    def chg(base):
        return safe_div(F.col("current") - F.col(base), base) * 100

    return g.select("symbol", "current", chg("_c2").alias("change_1d"), chg("_c5").alias("change_5d"),
                    chg("_c30").alias("change_30d"), chg("_c0").alias("change_90d"),
                    "high_90d", "low_90d", "avg_volume_10d", "volume")


def trailing_return(bars, k):
    """Return over the last k bars, or over what history there is."""
    w = W.partitionBy("symbol").orderBy(F.desc("ts"))
    last = bars.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k + 1)
    g = last.groupBy("symbol").agg(F.max_by("close", "ts").alias("_n"), F.min_by("close", "ts").alias("_o"), F.count(F.lit(1)).alias("_c"))
    return g.select("symbol", F.when(F.col("_c") >= 2, safe_div("_n", "_o") - 1).alias("trailing_return"))


def session_regime(bars, anchor, second):
    """Regime of each session from the anchor's range and change."""
    a = bars.filter(F.col("symbol").isin(anchor, second)).groupBy("session").agg(
        *[agg.alias(f"{name}_{s}") for s, sym in (("a", anchor), ("b", second)) for name, agg in (
            ("open", F.min_by("open", F.when(F.col("symbol") == sym, F.col("ts")))),
            ("close", F.max_by("close", F.when(F.col("symbol") == sym, F.col("ts")))),
            ("high", F.max(F.when(F.col("symbol") == sym, F.col("high")))),
            ("low", F.min(F.when(F.col("symbol") == sym, F.col("low")))))])
    chg = safe_div(F.col("close_a") - F.col("open_a"), "open_a") * 100
    rng = safe_div(F.col("high_a") - F.col("low_a"), "open_a") * 100
    return a.select(
        "session", win.regime_of(rng, chg).alias("regime"), F.coalesce(chg, F.lit(0.0)).alias("spy_change_pct"),
        F.coalesce(safe_div(F.col("close_b") - F.col("open_b"), "open_b") * 100, F.lit(0.0)).alias("qqq_change_pct"))


# -- equity curves ----------------------------------------------------------------------

def perf_metrics(equity, variant="engine", rf=0.0434, keys=("account",), order=("date",), value="value"):
    """Annualised Sharpe and Sortino; the four variants differ in the downside and in caps."""
    w = win.ordered(keys, order)
    prev = F.lag(value).over(w)
    d = equity.withColumn("_prev", prev).withColumn("_ret", safe_div(F.col(value) - F.col("_prev"), "_prev"))
    root = math.sqrt(DAYS)
    if variant == "tracker21":
        newest = W.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
        d = d.withColumn("_r", F.row_number().over(newest)).filter((F.col("_r") <= 21) & (F.col("_prev") > 0))
        g = d.groupBy(*keys).agg(F.count("_ret").alias("_n"), F.avg("_ret").alias("_m"), F.stddev_samp("_ret").alias("_s"))
        ok = (F.col("_n") >= 2) & (F.col("_s") > 0)
        return g.select(*keys, F.when(ok, (F.col("_m") - 0.045 / DAYS) / F.col("_s") * root).alias("sharpe_21d"))
    d = d.withColumn("_ex", F.col("_ret") - rf / DAYS)
    under = F.least("_ex", F.lit(0.0))
    neg = F.when(F.col("_ex") < 0, F.col("_ex"))
    g = d.groupBy(*keys).agg(
        F.count("_ret").alias("_n"), F.avg("_ex").alias("_m"), F.stddev_samp("_ex").alias("_s"),
        F.sqrt(F.avg(F.when(F.col("_ex").isNotNull(), under * under))).alias("_target"),
        F.coalesce(F.stddev_samp(neg), F.lit(0.0)).alias("_neg"))
    down = F.col("_target" if variant == "engine" else "_neg")
    none = {"engine": F.lit(float("inf")), "fast": F.lit(20.0), "service": F.lit(None).cast("double")}[variant]
    sharpe = F.when(F.col("_s") > 1e-12, F.col("_m") / F.col("_s") * root).otherwise(0.0)
    sortino = F.when(down > 1e-12, F.col("_m") / down * root).when(F.col("_m") > 0, none).otherwise(0.0)
    if variant == "fast":
        sortino = F.least(sortino, F.lit(20.0))
    enough = F.col("_n") >= (1 if variant == "fast" else 2)
    return g.select(*keys, F.when(enough, sharpe).alias("sharpe_ratio"), F.when(enough, sortino).alias("sortino_ratio"))


def max_drawdown(equity, keys=("account",)):
    d = win.drawdown(equity, keys=keys)
    return d.groupBy(*keys).agg(
        (F.min("drawdown") * 100).alias("max_drawdown"), F.min_by("date", F.struct("drawdown", "date")).alias("_d")
    ).select(*keys, "max_drawdown", F.when(F.col("max_drawdown") < 0, F.col("_d")).alias("max_drawdown_date"))


def current_drawdown(equity, keys=("account",)):
    g = equity.groupBy(*keys).agg(F.max("value").alias("peak"), F.max_by("value", "date").alias("current"), F.count(F.lit(1)).alias("_n"))
    return g.select(*keys, "peak", "current",
                    F.when(F.col("_n") >= 2, safe_div(F.col("peak") - F.col("current"), "peak") * 100).alias("drawdown_pct"))


def day_stats(equity, keys=("account",)):
    prev = F.lag("value").over(win.ordered(keys, ("date",)))
    d = equity.withColumn("_prev", prev).filter(F.col("_prev").isNotNull())
    d = d.withColumn("_pct", F.coalesce(safe_div(F.col("value") - F.col("_prev"), "_prev") * 100, F.lit(0.0)))
    first = F.struct("_pct", F.datediff(F.lit("1970-01-01"), F.col("date")))
    g = d.groupBy(*keys).agg(
        _cnt(F.col("_pct") >= 0).alias("win_days"), _cnt(F.col("_pct") < 0).alias("lose_days"),
        F.max_by("date", first).alias("best_day"), F.max("_pct").alias("best_pct"),
        F.min_by("date", F.struct("_pct", "date")).alias("worst_day"), F.min("_pct").alias("worst_pct"))
    return g.withColumn("win_day_rate", F.bround(safe_div("win_days", F.col("win_days") + F.col("lose_days")) * 100, 1))


def alpha_report(snapshots, keys=("account",)):
    def ends(c):
        return F.min_by(c, "date").alias(f"_{c}0"), F.max_by(c, "date").alias(f"_{c}1")

    g = snapshots.groupBy(*keys).agg(
        F.min("date").alias("period_start"), F.max("date").alias("period_end"), F.count(F.lit(1)).alias("snapshots_count"),
        *ends("equity"), *ends("spy_price"), *ends("qqq_price"), F.max_by("cash", "date").alias("cash")
    ).filter(F.col("snapshots_count") >= 2)

    def ret(c):
        return safe_div(F.col(f"_{c}1") - F.col(f"_{c}0"), f"_{c}0") * 100

    p = F.coalesce(ret("equity"), F.lit(0.0))
    return g.select(
        *keys, "period_start", "period_end", "snapshots_count", p.alias("portfolio_return_pct"),
        ret("spy_price").alias("spy_return_pct"), ret("qqq_price").alias("qqq_return_pct"),
        (p - ret("spy_price")).alias("alpha_vs_spy"), (p - ret("qqq_price")).alias("alpha_vs_qqq"),
        F.coalesce(safe_div("cash", "_equity1") * 100, F.lit(0.0)).alias("cash_pct"))


def weekly_pnl(snapshots, now_equity, asof, mode=None, keys=("account",)):
    """Return against the first snapshot of the last 7 days; mode-tagged rows are preferred.

    Untagged history whose base is more than 25 % away belongs to another account: 0.
    """
    week = snapshots.filter((F.col("date") >= F.date_sub(F.lit(asof).cast("date"), 7)) & (F.col("date") <= F.lit(asof).cast("date")))
    tagged = F.when(F.col("mode") == mode, F.col("date")) if mode else F.lit(None).cast("date")
    g = week.groupBy(*keys).agg(F.min_by("equity", "date").alias("_any"), F.min_by("equity", tagged).alias("_tag"))
    j = now_equity.join(g, list(keys), "left")
    base = F.coalesce("_tag", "_any") if mode else F.col("_any")
    foreign = F.lit(bool(mode)) & F.col("_tag").isNull() & (F.col("_any") > 0) & (F.abs(F.col("equity") - F.col("_any")) / F.col("_any") > 0.25)
    value = F.when(base.isNull() | (base <= 0) | F.coalesce(foreign, F.lit(False)), 0.0).otherwise((F.col("equity") - base) / base)
    return j.select(*keys, value.alias("weekly_pnl_pct"))


# -- trades and fitness -----------------------------------------------------------------

def trade_stats(journal, keys=()):
    """Closed trades only (sell/cover with a known profit); losses keep their sign."""
    closed = F.lower("action").isin("sell", "cover") & F.col("pnl").isNotNull()
    win_, loss = closed & (F.col("pnl") > 0), closed & (F.col("pnl") <= 0)
    g = journal.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_trades"), _cnt(closed).alias("closed_trades"), _cnt(win_).alias("_w"),
        F.sum(F.when(win_, F.col("pnl"))).alias("_ws"), _cnt(loss).alias("_l"), F.sum(F.when(loss, F.col("pnl"))).alias("_ls"))
    any_ = F.col("closed_trades") > 0
    return g.select(
        *keys, "total_trades", "closed_trades",
        F.when(any_, F.bround(F.col("_w") / F.col("closed_trades") * 100, 1)).alias("win_rate"),
        F.when(any_, F.coalesce(safe_div("_ws", "_w"), F.lit(0.0))).alias("avg_win"),
        F.when(any_, F.coalesce(safe_div("_ls", "_l"), F.lit(0.0))).alias("avg_loss"),
        safe_div("_ws", F.abs("_ls")).alias("profit_factor"))


def strategy_trade_stats(trades, keys):
    """Loss is pnl <= 0 and reported positive; a profit without losses has factor 10."""
    win_, loss = F.col("pnl") > 0, F.col("pnl") <= 0
    g = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_trades"), _cnt(win_).alias("_w"), _cnt(loss).alias("_l"),
        F.coalesce(F.sum(F.when(win_, F.col("pnl"))), F.lit(0.0)).alias("gross_profit"),
        F.abs(F.coalesce(F.sum(F.when(loss, F.col("pnl"))), F.lit(0.0))).alias("gross_loss"))
    pf = F.when(F.col("gross_loss") > 0, F.col("gross_profit") / F.col("gross_loss")).when(F.col("gross_profit") > 0, 10.0).otherwise(0.0)
    return g.select(
        *keys, "num_trades", (F.col("_w") / F.col("num_trades")).alias("win_rate"),
        F.least(pf, F.lit(10.0)).alias("profit_factor"), "gross_profit", "gross_loss",
        F.coalesce(safe_div("gross_profit", "_w"), F.lit(0.0)).alias("avg_win"),
        F.coalesce(safe_div("gross_loss", "_l"), F.lit(0.0)).alias("avg_loss"))


# Fitness weights and penalties by mode.
FITNESS = {
    "day": {"sharpe": 0.35, "sortino": 0.25, "ret": 0.20, "win": 0.10, "pf": 0.10,
            "dd": [(15.0, 20.0)], "low_win": 0.30, "few": 10, "many": 200},
    "swing": {"sharpe": 0.20, "sortino": 0.25, "ret": 0.35, "win": 0.08, "pf": 0.12,
              "dd": [(20.0, 25.0), (15.0, 10.0)], "low_win": 0.25, "few": 3, "many": 100},
}


def fitness(metrics, mode="day"):
    """Composite score per row; null Sharpe (too short a curve) scores -50."""
    p = FITNESS[mode]
    dd = F.abs("max_drawdown")
    penalty = None
    for cut, cost in p["dd"]:
        penalty = F.when(dd > cut, cost) if penalty is None else penalty.when(dd > cut, cost)
    score = (
        clamp("sharpe_ratio", -5.0, 10.0) * p["sharpe"] + clamp("sortino_ratio", -5.0, 20.0) * p["sortino"]
        + F.col("total_return_pct") * p["ret"] + F.col("win_rate") * p["win"] + F.least("profit_factor", F.lit(10.0)) * p["pf"]
        - penalty.otherwise(0.0) - F.when(F.col("win_rate") < p["low_win"], 10.0).otherwise(0.0)
        - F.when(F.col("num_trades") < p["few"], 15.0).otherwise(0.0) - F.when(F.col("num_trades") > p["many"], 5.0).otherwise(0.0))
    return metrics.withColumn("fitness", F.when(F.col("sharpe_ratio").isNull(), -50.0).otherwise(score))


def strategy_metrics(equity, trades, mode="day", keys=("account",), initial=None, rf=0.0434):
    """Curve and trade statistics of each strategy joined on its key, then the fitness.

    The fast Sharpe and Sortino, the drawdown and the return come from one window and one aggregate.
    """
    w = win.ordered(keys, ("date",))
    d = equity.withColumns({
        "_ex": safe_div("value", F.lag("value").over(w)) - 1 - rf / DAYS,
        "_peak": F.max("value").over(win.so_far(keys, ("date",)))})
    g = d.groupBy(*keys).agg(
        F.count("_ex").alias("_n"), F.avg("_ex").alias("_m"), F.stddev_samp("_ex").alias("_s"),
        F.coalesce(F.stddev_samp(F.when(F.col("_ex") < 0, F.col("_ex"))), F.lit(0.0)).alias("_neg"),
        (F.min(safe_div(F.col("value") - F.col("_peak"), "_peak")) * 100).alias("max_drawdown"),
        F.min_by("value", "date").alias("_v0"), F.max_by("value", "date").alias("_v1"))
    root, enough = math.sqrt(DAYS), F.col("_n") >= 1
    first = F.lit(float(initial)) if initial else F.col("_v0")
    sortino = F.when(F.col("_neg") > 1e-12, F.least(F.col("_m") / F.col("_neg") * root, F.lit(20.0))).when(F.col("_m") > 0, 20.0).otherwise(0.0)
    curve = g.select(
        *keys, F.when(enough, F.when(F.col("_s") > 1e-12, F.col("_m") / F.col("_s") * root).otherwise(0.0)).alias("sharpe_ratio"),
        F.when(enough, sortino).alias("sortino_ratio"), "max_drawdown", ((F.col("_v1") - first) / first * 100).alias("total_return_pct"))
    m = curve.join(strategy_trade_stats(trades, keys), list(keys), "left").fillna(0, ["num_trades", "win_rate", "profit_factor"])
    return fitness(m, mode)


def daily_metrics(day, capital, mode="day", keys=("variant",), rf=0.0434):
    """Fitness of strategies from their days alone: day(keys, session, pnl, trades, wins, gross_profit, gross_loss).

    The curve starts at ``capital`` the day before, as the default of the lag and the floor of the running peak, so one
    window and one aggregate do.
    """
    w = win.so_far(keys, ("session",))
    d = day.withColumn("value", capital + F.sum("pnl").over(w))
    d = d.withColumns({"_prev": F.coalesce(F.lag("value").over(win.ordered(keys, ("session",))), F.lit(float(capital))),
                       "_peak": F.greatest(F.max("value").over(w), F.lit(float(capital)))})
    d = d.withColumn("_ex", safe_div("value", "_prev") - 1 - rf / DAYS)
    g = d.groupBy(*keys).agg(
        F.count("_ex").alias("_n"), F.avg("_ex").alias("_m"), F.stddev_samp("_ex").alias("_s"),
        F.coalesce(F.stddev_samp(F.when(F.col("_ex") < 0, F.col("_ex"))), F.lit(0.0)).alias("_neg"),
        (F.min(safe_div(F.col("value") - F.col("_peak"), "_peak")) * 100).alias("max_drawdown"), F.max_by("value", "session").alias("_v1"),
        *[F.sum(c).alias(c) for c in ("trades", "wins", "gross_profit", "gross_loss")])
    root, enough = math.sqrt(DAYS), F.col("_n") >= 1
    sortino = F.when(F.col("_neg") > 1e-12, F.least(F.col("_m") / F.col("_neg") * root, F.lit(20.0))).when(F.col("_m") > 0, 20.0).otherwise(0.0)
    pf = F.when(F.col("gross_loss") > 0, F.col("gross_profit") / F.col("gross_loss")).when(F.col("gross_profit") > 0, 10.0).otherwise(0.0)
    m = g.select(
        *keys, F.when(enough, F.when(F.col("_s") > 1e-12, F.col("_m") / F.col("_s") * root).otherwise(0.0)).alias("sharpe_ratio"), F.when(enough, sortino).alias("sortino_ratio"),
        "max_drawdown", ((F.col("_v1") - capital) / capital * 100).alias("total_return_pct"), F.col("trades").alias("num_trades"),
        (F.col("wins") / F.col("trades")).alias("win_rate"), F.least(pf, F.lit(10.0)).alias("profit_factor"), "gross_profit", "gross_loss")
    return fitness(m, mode)


# -- journal ----------------------------------------------------------------------------

def journal_stats(journal, keys=()):
    ex = F.col("status") == "executed"
    return journal.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_entries"), _cnt(ex).alias("executed"), _cnt(F.col("status") == "blocked").alias("blocked"),
        _cnt(F.col("status") == "failed").alias("failed"), _cnt(ex & F.col("action").isin("buy", "cover")).alias("buys"),
        _cnt(ex & F.col("action").isin("sell", "short")).alias("sells"),
        F.countDistinct(F.when(ex, F.col("ticker"))).alias("unique_tickers"),
        F.countDistinct(F.when(ex, F.to_date("timestamp"))).alias("active_days"))


def journal_daily(journal, days=10):
    ex = journal.filter(F.col("status") == "executed")
    buy = F.col("action").isin("buy", "cover")
    return ex.groupBy(F.to_date("timestamp").alias("day")).agg(
        _cnt(buy).alias("buys"), _cnt(~buy).alias("sells"), F.count(F.lit(1)).alias("total")
    ).orderBy(F.desc("day")).limit(days)


def most_traded(journal, n=5):
    ex = journal.filter(F.col("status") == "executed")
    return ex.groupBy("ticker").agg(F.count(F.lit(1)).alias("trades")).orderBy(F.desc("trades"), "ticker").limit(n)


def trades_per_day(journal, day=None):
    ex = journal.filter(F.col("status") == "executed").withColumn("day", F.to_date("timestamp"))
    if day is not None:
        ex = ex.filter(F.col("day") == F.lit(day).cast("date"))
    return ex.groupBy("day").agg(F.count(F.lit(1)).alias("trades"))


# -- news, insiders and signals ---------------------------------------------------------

def known_at(rows, date, as_of=None, days=None):
    """Rows dated up to ``as_of`` (all without one), and no more than ``days`` before it."""
    if as_of is None:
        return rows
    day = F.lit(as_of).cast("date")
    rows = rows.filter(F.col(date) <= day)
    return rows if days is None else rows.filter(F.col(date) >= F.date_sub(day, days))


def news_sentiment(news, as_of=None, days=None):
    """Majority of labelled articles; with model confidences .7 of their mean + .3 of the share."""
    news = known_at(news, "date", as_of, days)
    lab = F.col("sentiment").isNotNull()
    bull, bear = F.col("sentiment") == "positive", F.col("sentiment") == "negative"
    neutral = lab & ~bull & ~bear
    mean = {k: F.avg(F.when(c, F.col("model_confidence"))).alias(f"_c_{k}") for k, c in
            (("bullish", bull), ("bearish", bear), ("neutral", F.col("sentiment") == "neutral"))}
    g = news.groupBy("symbol").agg(
        _cnt(lab).alias("articles"), _cnt(bull).alias("bullish"), _cnt(bear).alias("bearish"), _cnt(neutral).alias("neutral"), *mean.values())
    signal = F.when(F.col("bullish") > F.col("bearish"), "bullish").when(F.col("bearish") > F.col("bullish"), "bearish").otherwise("neutral")
    g = g.withColumn("signal", signal)
    share = safe_div(F.greatest("bullish", "bearish"), "articles") * 100
    model = F.when(F.col("signal") == "bullish", F.col("_c_bullish")).when(F.col("signal") == "bearish", F.col("_c_bearish")).otherwise(F.col("_c_neutral"))
    conf = F.when(F.col("articles") == 0, 0.0).when(model.isNotNull(), 0.7 * model + 0.3 * share).otherwise(share)
    return g.select("symbol", "articles", "bullish", "bearish", "neutral", "signal", conf.alias("confidence"))


# Words that make a headline negative.
NEGATIVE_WORDS = ["lawsuit", "fraud", "negative", "downturn", "decline", "investigation", "recall"]


def headline_score(news, words=NEGATIVE_WORDS, as_of=None, days=None):
    """8 without negative headlines, 6 with some, 3 above 30 %; a symbol without news has 5."""
    news = known_at(news, "date", as_of, days)
    text = F.lower("title")
    hit = None
    for word in words:
        one = F.contains(text, F.lit(word))
        hit = one if hit is None else hit | one
    known = F.col("title").isNotNull()
    g = news.groupBy("symbol").agg(_cnt(known).alias("articles"), _cnt(known & hit).alias("negative"))
    score = (F.when(F.col("articles") == 0, 5.0).when(F.col("negative") > F.col("articles") * 0.3, 3.0)
             .when(F.col("negative") > 0, 6.0).otherwise(8.0))
    return g.select("symbol", "articles", "negative", score.alias("score"))


def insider_flow(insider, as_of=None, days=None):
    """Buys, sells, net shares and the value and count ratios per symbol, from filings known at ``as_of``."""
    insider = known_at(insider, "filing_date", as_of, days)
    s, v = F.col("transaction_shares"), F.abs("transaction_value")
    traded = F.col("transaction_value").isNotNull() & (F.col("transaction_value") != 0)
    zero = F.lit(0.0)
    g = insider.groupBy("symbol").agg(
        _cnt(s > 0).alias("buys"), _cnt(s < 0).alias("sells"), F.coalesce(F.sum(s), zero).alias("net_shares"),
        F.coalesce(F.sum(F.when(s > 0, s)), zero).alias("bought"), F.coalesce(F.sum(F.when(s < 0, -s)), zero).alias("sold"),
        F.coalesce(F.sum(F.when(traded & (s > 0), v)), zero).alias("buy_value"),
        F.coalesce(F.sum(F.when(traded & (s < 0), v)), zero).alias("sell_value"), F.count("transaction_shares").alias("trades"),
        _cnt(s.isNotNull() & ~(s < 0)).alias("non_sales"))
    flow = safe_div(F.col("buy_value") - F.col("sell_value"), F.col("buy_value") + F.col("sell_value"))
    return g.withColumn("net_flow_ratio", F.coalesce(flow, zero)).withColumn("buy_ratio", safe_div("buys", F.col("buys") + F.col("sells")))


def signal_counts(signals):
    s = F.lower("signal")
    return signals.groupBy("date", "symbol").agg(*[_cnt(s == k).alias(k) for k in ("bullish", "bearish", "neutral")])
