"""Universe screens: one job scores every symbol of a panel.

Each screen reads a symbol's latest periods (newest first), scores them with ladders and emits
(symbol, sub-scores, score, max_score, signal). Cut-offs and points are the published rules.
"""

from functools import reduce

from pyspark.sql import functions as F

from barwright.functions.numeric import flag, ladder, nan_to_null, safe_div
from barwright.operators import aggs, folds, panel as P, windows as win

SIGNAL_VALUE = {"bullish": 1, "neutral": 0, "bearish": -1}


def band(score, high, low):
    return F.when(score >= high, "bullish").when(score <= low, "bearish").otherwise("neutral")


def tri(count, top=2):
    """At least ``top`` conditions bullish, none bearish."""
    return F.when(count >= top, "bullish").when(count == 0, "bearish").otherwise("neutral")


def points(*conds):
    return sum((flag(c) for c in conds), F.lit(0.0))


def nz(c):
    return F.coalesce(c, F.lit(0.0))


def finish(df, parts, weights=None, max_score=10.0, high=None, low=None):
    """Total the sub-scores and add the signal."""
    weights = weights or [1.0] * len(parts)
    total = sum((F.col(p) * w for p, w in zip(parts, weights)), F.lit(0.0))
    df = df.withColumn("score", total).withColumn("max_score", F.lit(float(max_score)))
    if high is None:
        high, low = 0.7 * max_score, 0.3 * max_score
    return df.withColumn("signal", band(F.col("score"), high, low)).select("symbol", *parts, "score", "max_score", "signal")


# -- rule votes -------------------------------------------------------------------------

def screen_fundamentals(panel, as_of):
    """Four votes on the newest metrics; the majority decides."""
    n = P.now
    p = P.profile(panel, as_of, 1)
    fcf, eps = n("free_cash_flow_per_share"), n("earnings_per_share")
    p = p.select(
        "symbol",
        tri(points(n("return_on_equity") > 0.15, n("net_margin") > 0.20, n("operating_margin") > 0.15)).alias("profitability"),
        tri(points(n("revenue_growth") > 0.10, n("earnings_growth") > 0.10, n("book_value_growth") > 0.10)).alias("growth"),
        tri(points(n("current_ratio") > 1.5, (n("debt_to_equity") != 0) & (n("debt_to_equity") < 0.5), (fcf != 0) & (eps != 0) & (fcf > eps * 0.8))).alias("health"),
        points(n("price_to_earnings_ratio") > 25, n("price_to_book_ratio") > 3, n("price_to_sales_ratio") > 5).alias("_dear"))
    p = p.withColumn("price_ratios", F.when(F.col("_dear") >= 2, "bearish").when(F.col("_dear") == 0, "bullish").otherwise("neutral"))
    votes = ["profitability", "growth", "health", "price_ratios"]
    bull = sum((flag(F.col(v) == "bullish") for v in votes), F.lit(0.0))
    bear = sum((flag(F.col(v) == "bearish") for v in votes), F.lit(0.0))
    sig = F.when(bull > bear, "bullish").when(bear > bull, "bearish").otherwise("neutral")
    return p.select("symbol", *votes, sig.alias("signal"), (F.bround(F.greatest(bull, bear) / 4, 2) * 100).alias("confidence"))


def screen_growth(panel, insider, as_of, periods=12):
    """Growth, valuation, margins, insiders and health, weighted; a positive trend slope over
    newest-first values (that is, falling over time) scores as the published rule has it."""
    n = P.now
    p = P.profile(panel, as_of, periods).filter(F.col("_n") >= 4).join(aggs.insider_flow(insider, as_of).select("symbol", "net_flow_ratio"), "symbol", "left")

    def slope(item):
        return P.trend_slope(P.series(item))

    rg, eg, fg = n("revenue_growth"), n("earnings_per_share_growth"), n("free_cash_flow_growth")
    growth = (ladder(rg, [(0.20, 0.4), (0.10, 0.2)]) + flag(rg.isNotNull() & (slope("revenue_growth") > 0), 0.1)
              + ladder(eg, [(0.20, 0.25), (0.10, 0.1)]) + flag(eg.isNotNull() & (slope("earnings_per_share_growth") > 0), 0.05)
              + flag(fg > 0.15, 0.1))
    value = ladder(n("peg_ratio"), [(1.0, 0.5), (2.0, 0.25)], op="<") + ladder(n("price_to_sales_ratio"), [(2.0, 0.5), (5.0, 0.25)], op="<")
    gm, om = n("gross_margin"), n("operating_margin")
    margins = (flag(gm > 0.5, 0.2) + flag(gm.isNotNull() & (slope("gross_margin") > 0), 0.2) + flag(om > 0.15, 0.2)
               + flag(om.isNotNull() & (slope("operating_margin") > 0), 0.2) + flag(slope("net_margin") > 0, 0.2))
    insiders = ladder(nz(F.col("net_flow_ratio")), [(0.5, 1.0), (0.1, 0.7), (-0.1, 0.5)], 0.2)
    health = 1.0 - ladder(n("debt_to_equity"), [(1.5, 0.5), (0.8, 0.2)]) - ladder(n("current_ratio"), [(1.0, 0.5), (1.5, 0.2)], op="<")
    one = F.lit(1.0)
    p = p.select("symbol", F.least(growth, one).alias("growth"), F.least(value, one).alias("valuation"), F.least(margins, one).alias("margins"),
                 insiders.alias("insider"), F.greatest(health, F.lit(0.0)).alias("health"))
    score = F.col("growth") * 0.40 + F.col("valuation") * 0.25 + F.col("margins") * 0.15 + F.col("insider") * 0.10 + F.col("health") * 0.10
    p = p.withColumn("score", score).withColumn("max_score", F.lit(1.0))
    sig = F.when(F.col("score") > 0.6, "bullish").when(F.col("score") < 0.4, "bearish").otherwise("neutral")
    return p.withColumn("signal", sig).withColumn("confidence", F.bround(F.abs(F.col("score") - 0.5) * 200, 0))


def screen_sentiment(insider, news, as_of=None):
    """Insider trades weigh .3, labelled articles .7; the larger side wins."""
    i = aggs.insider_flow(insider, as_of).select("symbol", F.col("non_sales").alias("_ib"), F.col("sells").alias("_is"), F.col("trades").alias("_in"))
    n = aggs.news_sentiment(news, as_of).select("symbol", F.col("bullish").alias("_nb"), F.col("bearish").alias("_ns"), F.col("articles").alias("_nn"))
    j = i.join(n, "symbol", "full").fillna(0)
    bull, bear = F.col("_ib") * 0.3 + F.col("_nb") * 0.7, F.col("_is") * 0.3 + F.col("_ns") * 0.7
    sig = F.when(bull > bear, "bullish").when(bear > bull, "bearish").otherwise("neutral")
    conf = nz(safe_div(F.greatest(bull, bear), F.col("_in") * 0.3 + F.col("_nn") * 0.7) * 100)
    return j.select("symbol", bull.alias("bullish_weight"), bear.alias("bearish_weight"), sig.alias("signal"), conf.alias("confidence"))


# -- technical ensemble -----------------------------------------------------------------

# Weights of the five technical sub-signals.
TECH_WEIGHTS = {"trend": 0.25, "mean_reversion": 0.20, "momentum": 0.25, "volatility": 0.15, "stat_arb": 0.15}


def technical_signals(bars):
    """Long (symbol, strategy, signal, confidence) from each symbol's last bar.

    One shuffle and sort by symbol serves every indicator; only the last row survives.
    """
    b = folds.emas(bars, "close", {"ema_8": 8, "ema_21": 21, "ema_55": 55})
    b = win.atr(win.bollinger(win.zscore(folds.adx(b))))
    b = win.hurst_moves(win.rolling_moments(win.vol_regime(win.momentum(b))))
    cols = ["ema_8", "ema_21", "ema_55", "adx", "zscore", "pct_b", "momentum_score", "volume_momentum", "vol_regime", "vol_z", "skew"]
    last = b.groupBy("symbol").agg(F.max_by(F.struct(*cols), "ts").alias("l"), *win.hurst_aggs()).select("symbol", "l.*", win.hurst_value().alias("hurst"))
    one = F.lit(1.0)
    s, m = F.col("ema_8") > F.col("ema_21"), F.col("ema_21") > F.col("ema_55")
    z, mom, vz, h = F.col("zscore"), F.col("momentum_score"), F.col("vol_z"), F.col("hurst")
    heavy = F.col("volume_momentum") > 1.0
    rules = {
        "trend": (s & m, ~s & ~m, F.col("adx") / 100),
        "mean_reversion": ((z < -2) & (F.col("pct_b") < 0.2), (z > 2) & (F.col("pct_b") > 0.8), F.least(F.abs(z) / 4, one)),
        "momentum": ((mom > 0.05) & heavy, (mom < -0.05) & heavy, F.least(F.abs(mom) * 5, one)),
        "volatility": ((F.col("vol_regime") < 0.8) & (vz < -1), (F.col("vol_regime") > 1.2) & (vz > 1), F.least(F.abs(vz) / 3, one)),
        "stat_arb": ((h < 0.4) & (F.col("skew") > 1), (h < 0.4) & (F.col("skew") < -1), (0.5 - h) * 2),
    }
    rows = [F.struct(F.lit(k).alias("strategy"), F.when(up, "bullish").when(down, "bearish").otherwise("neutral").alias("signal"),
                     F.when(up | down, conf).otherwise(0.5).alias("confidence")) for k, (up, down, conf) in rules.items()]
    return last.select("symbol", F.inline(F.array(*rows)))


def combine_signals(signals, weights, by=("symbol",), name="strategy"):
    """Weighted vote: sum(v w c) / sum(w c); beyond +-0.2 it takes a side."""
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    v = F.when(F.col("signal") == "bullish", 1.0).when(F.col("signal") == "bearish", -1.0).otherwise(0.0)
    wc = F.try_element_at(w, F.col(name)) * F.col("confidence")
    g = signals.groupBy(*by).agg(F.sum(v * wc).alias("_v"), F.sum(wc).alias("_w"))
    score = F.when(F.col("_w") > 0, F.col("_v") / F.col("_w")).otherwise(0.0)
    sig = F.when(score > 0.2, "bullish").when(score < -0.2, "bearish").otherwise("neutral")
    return g.select(*by, sig.alias("signal"), F.abs(score).alias("confidence"))


def screen_technical(bars):
    return combine_signals(technical_signals(bars), TECH_WEIGHTS)


def regime_signal(regimes, universe, on="mode"):
    """A regime per market (mode) carried to every symbol of that market by an equi-join."""
    sig = F.when(F.col("regime") == "trending_up", "bullish").when(F.col("regime") == "trending_down", "bearish").otherwise("neutral")
    return universe.join(regimes, on).select(on, "symbol", "regime", sig.alias("signal"), "confidence")


def momentum_brief(pack, news, insider, fundamentals, as_of=None):
    """Signal, catalyst and reason per symbol, from the return pack and what else is known of it."""
    flow = aggs.insider_flow(insider, as_of).select("symbol", (F.col("buys") > F.col("sells")).alias("_buying"))
    seen = aggs.known_at(news, "date", as_of).select("symbol", F.lit(True).alias("_news")).distinct()
    j = pack.join(seen, "symbol", "left").join(flow, "symbol", "left").join(fundamentals, "symbol", "left")
    d1, d5, d30 = nz(F.col("change_1d")), nz(F.col("change_5d")), nz(F.col("change_30d"))
    up, down = (d5 > 5) & (d30 > 10), (d5 < -5) & (d30 < -10)

    def moved(c, cut, when):
        return F.when(F.abs(c) > cut, F.format_string("%s %.1f%% " + when, F.when(c > 0, "up").otherwise("down"), F.abs(c)))

    why = F.concat_ws("; ", moved(d1, 3, "today"), moved(d5, 5, "this week"),
                      F.when(F.col("revenue_growth") > 0.2, F.format_string("rev growth %.0f%%", F.col("revenue_growth") * 100)),
                      F.when((F.col("pe_ratio") != 0) & (F.col("pe_ratio") < 15), F.format_string("PE %.1f", F.col("pe_ratio"))))
    return j.select(
        "symbol", F.when(up, "bullish").when(down, "bearish").otherwise("neutral").alias("signal"),
        F.when(up | down, F.least(F.lit(0.9), 0.5 + F.abs(d5) / 50)).otherwise(0.5).alias("confidence"),
        F.when(nz(F.col("_buying").cast("double")) > 0, "insider").when(F.col("_news"), "news").otherwise("momentum").alias("catalyst"),
        F.when(why == "", "steady").otherwise(why).alias("reason"))


def anomalies(pack):
    """Volume above twice its mean, and one-day moves above 8 %."""
    ratio = safe_div("volume", "avg_volume_10d")
    vol = pack.filter(ratio > 2.0).select("symbol", F.lit("volume").alias("kind"), ratio.alias("value"))
    move = pack.filter(F.abs("change_1d") > 8).select("symbol", F.lit("move").alias("kind"), F.col("change_1d").alias("value"))
    return vol.unionByName(move)


def macro_sentiment(change_1d):
    return F.when(change_1d > 1, "risk-on").when(change_1d < -1, "risk-off").otherwise("mixed")


# -- investor screens -------------------------------------------------------------------

def screen_graham(panel, as_of):
    p = P.profile(panel, as_of, 10)
    n, eps, div = P.now, P.series("earnings_per_share"), P.series("dividends_and_other_cash_distributions")
    good = P.count_if(eps, lambda v: v > 0)
    earnings = F.when(F.size(eps) < 2, 0.0).otherwise(
        F.when(good == F.size(eps), 3.0).when(good >= F.size(eps) * 0.8, 2.0).otherwise(0.0) + flag(P.first(eps) > P.last(eps)))
    cr = F.when(nz(n("current_liabilities")) > 0, nz(n("current_assets")) / n("current_liabilities"))
    dr = F.when(nz(n("total_assets")) > 0, nz(n("total_liabilities")) / n("total_assets"))
    strength = ladder(cr, [(2.0, 2.0), (1.5, 1.0)], op=">=") + ladder(dr, [(0.5, 2.0), (0.8, 1.0)], op="<") + flag(P.majority(div, lambda v: v < 0))
    cap, sh = n("market_cap"), nz(n("outstanding_shares"))
    ncav = nz(n("current_assets")) - nz(n("total_liabilities"))
    net = F.when((ncav > 0) & (sh > 0), F.when(ncav > cap, 4.0).when(ncav / sh >= cap / sh * 0.67, 2.0).otherwise(0.0)).otherwise(0.0)
    e0, bv = nz(n("earnings_per_share")), nz(n("book_value_per_share"))
    graham = F.when((e0 > 0) & (bv > 0) & (sh > 0), F.sqrt(22.5 * e0 * bv))
    mos = safe_div(graham - cap / sh, cap / sh)
    value = F.when(cap > 0, net + ladder(mos, [(0.5, 3.0), (0.2, 1.0)])).otherwise(0.0)
    p = p.select("symbol", earnings.alias("earnings"), strength.alias("strength"), value.alias("valuation"))
    return finish(p, ["earnings", "strength", "valuation"], max_score=15.0)


def screen_ackman(panel, as_of):
    p = P.profile(panel, as_of, 5)
    n, rev, om, fcf = P.now, P.series("revenue"), P.series("operating_margin"), P.series("free_cash_flow")
    up = (F.size(rev) >= 2) & (P.first(rev) != 0) & (P.last(rev) != 0) & (P.first(rev) > P.last(rev))
    g = P.total_growth(rev)
    quality = (F.when(up, F.when(g > 0.5, 2.0).otherwise(1.0)).otherwise(0.0) + flag(P.majority(om, lambda v: v > 0.15), 2.0)
               + flag(P.majority(fcf, lambda v: v > 0)) + flag(n("return_on_equity") > 0.15, 2.0))
    de, div, sh = P.series("debt_to_equity"), P.series("dividends_and_other_cash_distributions"), P.series("outstanding_shares")
    liab = F.filter(F.transform("_p", lambda x: F.when((x["total_liabilities"] != 0) & (x["total_assets"] > 0), x["total_liabilities"] / x["total_assets"])), lambda v: v.isNotNull())
    lever = F.when(F.size(de) > 0, flag(P.majority(de, lambda v: v < 1.0), 2.0)).otherwise(flag(P.majority(liab, lambda v: v < 0.5), 2.0))
    discipline = lever + flag(P.majority(div, lambda v: v < 0)) + flag((F.size(sh) >= 2) & (P.first(sh) < P.last(sh)))
    activism = flag((F.size(rev) >= 2) & (F.size(om) > 0) & (nz(g) > 0.15) & (P.mean(om) < 0.10), 2.0)
    fc, cap = nz(n("free_cash_flow")), n("market_cap")
    iv = P.pv(fc, 0.06, 0.10, 5) + fc * 1.06 ** 5 * 15 / 1.10 ** 5
    value = F.when((fc > 0) & cap.isNotNull(), ladder(safe_div(iv - cap, cap), [(0.3, 3.0), (0.1, 1.0)])).otherwise(0.0)
    p = p.select("symbol", quality.alias("quality"), discipline.alias("discipline"), activism.alias("activism"), value.alias("valuation"))
    return finish(p, ["quality", "discipline", "activism", "valuation"], max_score=20.0)


def screen_wood(panel, as_of):
    p = P.profile(panel, as_of, 5)
    n = P.now
    rev, gm, opex = P.series("revenue", True), P.series("gross_margin"), P.series("operating_expense", True)
    rd, rdz = P.series("research_and_development"), P.series("research_and_development", True)
    g = P.growth_series(rev)
    enough = F.size(rev) >= 3
    growth = F.when(enough, flag((F.size(g) >= 2) & (P.first(g) > P.last(g)), 2.0) + ladder(P.first(g), [(1.0, 3.0), (0.5, 2.0), (0.2, 1.0)])).otherwise(0.0)
    margin = F.when(F.size(gm) >= 2, ladder(P.first(gm) - P.last(gm), [(0.05, 2.0), (0.0, 1.0)]) + flag(P.first(gm) > 0.50, 2.0)).otherwise(0.0)
    lever = flag((F.size(rev) >= 2) & (F.size(opex) >= 2) & (P.total_growth(rev) > P.total_growth(opex)), 2.0)
    intensity = ladder(safe_div(P.first(rd), P.first(rev)), [(0.15, 3.0), (0.08, 2.0), (0.05, 1.0)])
    disruptive = (growth + margin + lever + intensity) / 12 * 5
    fcf, om, capex, div = P.series("free_cash_flow", True), P.series("operating_margin", True), P.series("capital_expenditure", True), P.series("dividends_and_other_cash_distributions", True)
    research = F.when((F.size(rdz) >= 2) & (F.size(rev) > 0), ladder(P.total_growth(rdz), [(0.5, 3.0), (0.2, 2.0)]) + flag(
        safe_div(P.first(rdz), P.first(rev)) > safe_div(P.last(rdz), P.last(rev)), 2.0)).otherwise(0.0)
    pos = P.count_if(fcf, lambda v: v > 0)
    cash = F.when(F.size(fcf) >= 2, F.when((P.total_growth(fcf) > 0.3) & (pos == F.size(fcf)), 3.0).when(pos >= F.size(fcf) * 0.75, 2.0)
                  .when(pos > F.size(fcf) * 0.5, 1.0).otherwise(0.0)).otherwise(0.0)
    trend = P.first(om) - P.last(om)
    eff = F.when(F.size(om) >= 2, F.when((P.first(om) > 0.15) & (trend > 0), 3.0).when(P.first(om) > 0.10, 2.0).when(trend > 0, 1.0).otherwise(0.0)).otherwise(0.0)
    ci = safe_div(F.abs(P.first(capex)), P.first(rev))
    cg = safe_div(F.abs(P.first(capex)) - F.abs(P.last(capex)), F.abs(P.last(capex)))
    alloc = F.when((F.size(capex) >= 2) & (F.size(rev) > 0), F.when((ci > 0.10) & (cg > 0.2), 2.0).when(ci > 0.05, 1.0).otherwise(0.0)).otherwise(0.0)
    pay = safe_div(P.first(div), P.first(fcf))
    reinvest = F.when((F.size(div) > 0) & (F.size(fcf) > 0), ladder(pay, [(0.2, 2.0), (0.4, 1.0)], op="<")).otherwise(0.0)
    innovation = (research + cash + eff + alloc + reinvest) / 15 * 5
    fc, cap = nz(n("free_cash_flow")), n("market_cap")
    iv = P.pv(fc, 0.20, 0.15, 5) + fc * 1.20 ** 5 * 25 / 1.15 ** 5
    value = F.when((fc > 0) & cap.isNotNull(), ladder(safe_div(iv - cap, cap), [(0.5, 3.0), (0.2, 1.0)])).otherwise(0.0)
    p = p.select("symbol", disruptive.alias("disruptive"), innovation.alias("innovation"), value.alias("valuation"))
    return finish(p, ["disruptive", "innovation", "valuation"], max_score=15.0)


def screen_burry(panel, insider, news, as_of, days=365):
    """Insiders and headlines of the ``days`` before ``as_of`` only."""
    n = P.now
    flow = aggs.insider_flow(insider, as_of, days).select("symbol", "bought", "sold")
    neg = aggs.known_at(news, "date", as_of, days).filter(F.lower("sentiment").isin("negative", "bearish")).groupBy("symbol").agg(F.count(F.lit(1)).alias("_neg"))
    p = P.profile(panel, as_of, 5).join(flow, "symbol", "left").join(neg, "symbol", "left")
    value = ladder(safe_div(n("free_cash_flow"), n("market_cap")), [(0.15, 4.0), (0.12, 3.0), (0.08, 2.0)], op=">=") + ladder(n("ev_to_ebit"), [(6.0, 2.0), (10.0, 1.0)], op="<")
    sheet = ladder(n("debt_to_equity"), [(0.5, 2.0), (1.0, 1.0)], op="<") + flag(n("cash_and_equivalents") > n("total_debt"))
    net = F.col("bought") - F.col("sold")
    insiders = F.when(net > 0, F.when(net / F.greatest("sold", F.lit(1.0)) > 1, 2.0).otherwise(1.0)).otherwise(0.0)
    p = p.select("symbol", value.alias("value"), sheet.alias("balance_sheet"), insiders.alias("insider"), flag(F.col("_neg") >= 5).alias("contrarian"))
    return finish(p, ["value", "balance_sheet", "insider", "contrarian"], max_score=12.0)


def _with_mood(p, insider, news, as_of, words=None):
    """Headline score (5 without news) and the insider buy ratio per symbol, as known at ``as_of``."""
    h = aggs.headline_score(news, words or aggs.NEGATIVE_WORDS, as_of).select("symbol", F.col("score").alias("_mood"))
    f = aggs.insider_flow(insider, as_of).select("symbol", "buy_ratio")
    return p.join(h, "symbol", "left").join(f, "symbol", "left").withColumn("_mood", F.coalesce("_mood", F.lit(5.0)))


def insider_score():
    b = F.col("buy_ratio")
    return F.when(b.isNull(), 5.0).otherwise(ladder(b, [(0.7, 8.0), (0.4, 6.0)], 4.0))


def _tens(raw, top):
    return F.least(F.lit(10.0), raw / top * 10)


def screen_lynch(panel, insider, news, as_of, words=None):
    p = _with_mood(P.profile(panel, as_of, 5), insider, news, as_of, words)
    n, rev, eps = P.now, P.series("revenue"), P.series("earnings_per_share")
    cuts = [(0.25, 3.0), (0.10, 2.0), (0.02, 1.0)]
    growth = F.when(F.col("_n") >= 2, _tens(
        F.when(P.last(rev) > 0, ladder(P.total_growth(rev), cuts)).otherwise(0.0)
        + F.when(F.abs(P.last(eps)) > 1e-9, ladder(P.total_growth(eps), cuts)).otherwise(0.0), 6)).otherwise(0.0)
    debt, eq, om, fcf = P.series("total_debt"), P.series("shareholders_equity"), P.series("operating_margin"), P.series("free_cash_flow")
    de = F.when((F.size(debt) > 0) & (F.size(debt) == F.size(eq)), P.first(debt) / F.when(P.first(eq) != 0, P.first(eq)).otherwise(1e-9))
    fundamentals = _tens(ladder(de, [(0.5, 2.0), (1.0, 1.0)], op="<") + ladder(P.first(om), [(0.20, 2.0), (0.10, 1.0)]) + flag(P.first(fcf) > 0, 2.0), 6)
    ni = P.series("net_income")
    pe = F.when(P.first(ni) > 0, n("market_cap") / P.first(ni))
    years = F.size(eps) - 1
    rate = F.when((F.size(eps) >= 2) & (P.last(eps) > 0), F.when(P.first(eps) > 0, P.cagr(eps)).otherwise((P.first(eps) - P.last(eps)) / (P.last(eps) * years)))
    peg = F.when((pe != 0) & (rate > 0), pe / (rate * 100))
    value = F.when(n("market_cap").isNotNull(), _tens(ladder(pe, [(15.0, 2.0), (25.0, 1.0)], op="<") + ladder(peg, [(1.0, 3.0), (2.0, 2.0), (3.0, 1.0)], op="<"), 5)).otherwise(0.0)
    p = p.select("symbol", growth.alias("growth"), value.alias("valuation"), fundamentals.alias("fundamentals"), F.col("_mood").alias("sentiment"), insider_score().alias("insider"))
    return finish(p, ["growth", "valuation", "fundamentals", "sentiment", "insider"], [0.30, 0.25, 0.20, 0.15, 0.10], 10.0, 7.5, 4.5)


def screen_pabrai(panel, as_of):
    p = P.profile(panel, as_of, 8)
    n, fcf, rev = P.now, P.series("free_cash_flow"), P.series("revenue")
    cash, debt, eq = n("cash_and_equivalents"), n("total_debt"), n("shareholders_equity")
    cr = F.when(n("current_liabilities") > 0, n("current_assets") / n("current_liabilities"))
    recent, old = P.recent_vs_old(fcf, 3)
    three = F.size(fcf) >= 3
    downside = (flag(cash - debt > 0, 3.0) + ladder(cr, [(2.0, 2.0), (1.2, 1.0)], op=">=") + ladder(F.when(eq > 0, debt / eq), [(0.3, 2.0), (0.7, 1.0)], op="<")
                + F.when(three, F.when((recent > 0) & (recent >= old), 2.0).when(recent > 0, 1.0).otherwise(0.0)).otherwise(0.0))
    cap = n("market_cap")
    norm = P.recent_mean(fcf, 5)
    y = F.when((cap > 0) & three & (norm > 0), norm / cap)
    light = F.filter(F.transform("_p", lambda x: F.when(x["revenue"] > 0, F.abs(F.coalesce(x["capital_expenditure"], F.lit(0.0))) / x["revenue"])), lambda v: v.isNotNull())
    value = F.when(y.isNotNull(), ladder(y, [(0.10, 4.0), (0.07, 3.0), (0.05, 2.0), (0.03, 1.0)]) + F.when(F.col("_n") >= 3, ladder(P.mean(light), [(0.05, 2.0), (0.10, 1.0)], op="<")).otherwise(0.0)).otherwise(0.0)
    rr, ro = P.recent_vs_old(rev, 3)
    double = (F.when((F.size(rev) >= 3) & (ro > 0), ladder(rr / ro - 1, [(0.15, 2.0), (0.05, 1.0)])).otherwise(0.0)
              + F.when(three, ladder(safe_div(recent, old) - 1, [(0.20, 3.0), (0.08, 2.0), (0.0, 1.0)])).otherwise(0.0) + ladder(y, [(0.08, 3.0), (0.05, 1.0)]))
    ten = F.lit(10.0)
    p = p.select("symbol", F.least(downside, ten).alias("downside"), F.least(value, ten).alias("valuation"), F.when(cap > 0, F.least(double, ten)).otherwise(0.0).alias("double_potential"))
    return finish(p, ["downside", "valuation", "double_potential"], [0.45, 0.35, 0.20], 10.0, 7.5, 4.0)


def screen_fisher(panel, insider, news, as_of, words=None):
    p = _with_mood(P.profile(panel, as_of, 5), insider, news, as_of, words)
    n, rev, eps, rd = P.now, P.series("revenue"), P.series("earnings_per_share"), P.series("research_and_development")
    cuts = [(0.20, 3.0), (0.10, 2.0), (0.03, 1.0)]
    ratio = F.when((F.size(rd) > 0) & (F.size(rd) == F.size(rev)), P.first(rd) / F.when(P.first(rev) != 0, P.first(rev)).otherwise(1e-9))
    two = F.col("_n") >= 2
    rdp = F.when((ratio >= 0.03) & (ratio <= 0.15), 3.0).when(ratio > 0.15, 2.0).when(ratio > 0, 1.0).otherwise(0.0)
    growth = F.when(two, _tens(ladder(P.cagr(rev), cuts) + ladder(P.cagr(eps), cuts) + rdp, 9)).otherwise(0.0)
    om, gm, ni, eq = P.series("operating_margin"), P.series("gross_margin"), P.series("net_income"), P.series("shareholders_equity")
    trend = F.when(F.size(om) >= 2, F.when((P.first(om) >= P.last(om)) & (P.last(om) > 0), 2.0).when(P.first(om) > 0, 1.0).otherwise(0.0)).otherwise(0.0)
    steady = ladder(F.when(F.size(om) >= 3, P.std(om)), [(0.02, 2.0), (0.05, 1.0)], op="<")
    margins = F.when(two, _tens(trend + ladder(P.first(gm), [(0.5, 2.0), (0.3, 1.0)]) + steady, 6)).otherwise(0.0)
    e0 = F.when(P.first(eq) != 0, P.first(eq)).otherwise(1e-9)
    roe = F.when((F.size(ni) > 0) & (F.size(ni) == F.size(eq)) & (P.first(ni) > 0), P.first(ni) / e0)
    debt, fcf = P.series("total_debt"), P.series("free_cash_flow")
    de = F.when((F.size(debt) > 0) & (F.size(debt) == F.size(eq)), P.first(debt) / e0)
    cash = flag((F.size(fcf) >= 2) & (P.count_if(fcf, lambda v: v > 0) / F.size(fcf) > 0.8))
    mgmt = _tens(ladder(roe, [(0.2, 3.0), (0.1, 2.0), (0.0, 1.0)]) + ladder(de, [(0.3, 2.0), (1.0, 1.0)], op="<") + cash, 6)
    cap, pc = n("market_cap"), [(20.0, 2.0), (30.0, 1.0)]
    value = _tens(ladder(F.when(P.first(ni) > 0, cap / P.first(ni)), pc, op="<") + ladder(F.when(P.first(fcf) > 0, cap / P.first(fcf)), pc, op="<"), 4)
    p = p.select("symbol", growth.alias("growth"), margins.alias("margins"), mgmt.alias("management"), value.alias("valuation"), insider_score().alias("insider"), F.col("_mood").alias("sentiment"))
    return finish(p, ["growth", "margins", "management", "valuation", "insider", "sentiment"], [0.30, 0.25, 0.20, 0.15, 0.05, 0.05], 10.0, 7.5, 4.5)


def screen_druckenmiller(panel, bars, insider, news, as_of, words=None):
    b = win.returns(bars.filter(F.col("ts") <= F.lit(as_of).cast("date")))
    px = b.groupBy("symbol").agg(F.count("close").alias("_k"), F.min_by("close", "ts").alias("_c0"), F.max_by("close", "ts").alias("_c1"), F.stddev_pop("ret").alias("_sd"))
    p = _with_mood(P.profile(panel, as_of, 5), insider, news, as_of, words).join(px, "symbol", "left")
    n, rev, eps, eq, debt = P.now, P.series("revenue"), P.series("earnings_per_share"), P.series("shareholders_equity"), P.series("total_debt")
    cuts = [(0.08, 3.0), (0.04, 2.0), (0.01, 1.0)]
    move = F.when((F.col("_k") > 30) & (F.col("_c0") > 0), (F.col("_c1") - F.col("_c0")) / F.col("_c0"))
    growth = F.when(F.col("_n") >= 2, _tens(ladder(P.cagr(rev), cuts) + ladder(P.cagr(eps), cuts) + ladder(move, [(0.50, 3.0), (0.20, 2.0), (0.0, 1.0)]), 9)).otherwise(0.0)
    de = F.when((F.size(debt) > 0) & (F.size(debt) == F.size(eq)), P.first(debt) / F.when(P.first(eq) != 0, P.first(eq)).otherwise(1e-9))
    calm = ladder(F.when(F.col("_k") > 10, F.col("_sd")), [(0.01, 3.0), (0.02, 2.0), (0.04, 1.0)], op="<")
    risk = F.when(F.col("_k") > 0, _tens(ladder(de, [(0.3, 3.0), (0.7, 2.0), (1.5, 1.0)], op="<") + calm, 6)).otherwise(0.0)
    cap = n("market_cap")
    ev = cap + nz(P.first(debt)) - nz(P.first(P.series("cash_and_equivalents")))

    def multiple(top, item, cuts):
        x = P.first(P.series(item))
        return ladder(F.when((top > 0) & (x > 0), top / x), cuts, op="<")

    pc = [(15.0, 2.0), (25.0, 1.0)]
    value = F.when(cap.isNotNull(), _tens(multiple(cap, "net_income", pc) + multiple(cap, "free_cash_flow", pc) + multiple(ev, "ebit", pc)
                                          + multiple(ev, "ebitda", [(10.0, 2.0), (18.0, 1.0)]), 8)).otherwise(0.0)
    p = p.select("symbol", growth.alias("growth_momentum"), risk.alias("risk_reward"), value.alias("valuation"), F.col("_mood").alias("sentiment"), insider_score().alias("insider"))
    return finish(p, ["growth_momentum", "risk_reward", "valuation", "sentiment", "insider"], [0.35, 0.20, 0.20, 0.15, 0.10], 10.0, 7.5, 4.5)


def screen_damodaran(panel, as_of):
    """Growth, risk and relative P/E scores; a ten-year FCFF DCF with fading growth sets the signal."""
    n = P.now
    p = P.profile(panel, as_of, 5)
    rev, fcf, pe = P.series("revenue", True), P.series("free_cash_flow", True), P.series("price_to_earnings_ratio", True)
    rate = F.when((F.size(rev) >= 2) & (P.last(rev) > 0), F.pow(P.first(rev) / P.last(rev), 1.0 / (F.size(rev) - 1)) - 1)
    growth = F.when(F.col("_n") >= 2, ladder(rate, [(0.08, 2.0), (0.03, 1.0)]) + flag((F.size(fcf) >= 2) & (P.first(fcf) > P.last(fcf))) + flag(n("return_on_invested_capital") > 0.10)).otherwise(0.0)
    cover = F.when((n("ebit") != 0) & (n("interest_expense") != 0), n("ebit") / F.abs(n("interest_expense")))
    risk = points(n("beta") < 1.3, n("debt_to_equity") < 1, cover > 3)
    med = P.upper_median(pe)
    rel = F.when(F.size(pe) >= 5, F.when(P.first(pe) < 0.7 * med, 1.0).when(P.first(pe) > 1.3 * med, -1.0).otherwise(0.0)).otherwise(0.0)
    base, coe, f0, cap = F.least(F.coalesce(rate, F.lit(0.04)), F.lit(0.12)), 0.04 + F.coalesce(n("beta"), F.lit(1.0)) * 0.05, n("free_cash_flow"), n("market_cap")
    p = p.select("symbol", growth.alias("growth"), risk.alias("risk"), rel.alias("relative_valuation"), base.alias("_g"), coe.alias("_r"), cap.alias("_cap"),
                 F.when((F.col("_n") >= 2) & (f0 != 0) & (n("outstanding_shares") != 0), f0).alias("_f"))
    stream = F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.lit(0.0),
                         lambda s, y: s + F.col("_f") * (1 + F.col("_g") + (y - 1) * (0.025 - F.col("_g")) / 9) / F.pow(1 + F.col("_r"), y))
    iv = stream + F.col("_f") * 1.025 / (F.col("_r") - 0.025) / F.pow(1 + F.col("_r"), F.lit(10))
    p = p.withColumn("margin_of_safety", F.when((iv != 0) & (F.col("_cap") != 0), (iv - F.col("_cap")) / F.col("_cap")))
    score = F.col("growth") + F.col("risk") + F.col("relative_valuation")
    return p.select("symbol", "growth", "risk", "relative_valuation", score.alias("score"), F.lit(8.0).alias("max_score"), "margin_of_safety", band(F.col("margin_of_safety"), 0.25, -0.25).alias("signal"))


def _not_falling(a, compat):
    """Share of adjacent periods without a decline (``compat`` counts rising ones as declines)."""
    prev = F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))
    down = F.zip_with(F.slice(a, 1, F.size(prev)), prev, lambda c, q: (c > q) if compat else (c < q))
    return 1 - safe_div(F.size(F.filter(down, lambda v: v)), F.size(prev))


def screen_jhunjhunwala(panel, as_of, compat=False):
    n = P.now
    p = P.profile(panel, as_of, 5)

    def positive(item, k=None):
        rows = F.col("_p") if k is None else F.slice("_p", 1, k)
        return F.filter(F.transform(rows, lambda x: x[item]), lambda v: v > 0)

    def rate3(a):
        return F.when(F.size(a) >= 3, P.cagr(a) * 100)

    eps, rev, ni = positive("earnings_per_share"), positive("revenue"), positive("net_income")
    ta, tl, n0 = n("total_assets"), n("total_liabilities"), n("net_income")
    both = (ta != 0) & (tl != 0)
    eq = ta - tl
    roe = F.when(both & (n0 > 0) & (eq > 0), n0 / eq * 100)
    om = F.when((n("operating_income") != 0) & (n("revenue") > 0), n("operating_income") / n("revenue") * 100)
    cuts = [(20.0, 3.0), (15.0, 2.0), (10.0, 1.0)]
    profit = ladder(roe, cuts) + ladder(om, [(20.0, 2.0), (15.0, 1.0)]) + ladder(rate3(eps), cuts)
    steady = flag((F.size(rev) >= 3) & (_not_falling(rev, compat) >= 0.8))
    growth = F.when(F.col("_n") >= 3, ladder(rate3(rev), cuts) + ladder(rate3(ni), [(25.0, 3.0), (20.0, 2.0), (15.0, 1.0)]) + steady).otherwise(0.0)
    dr = F.when(both & (ta > 0), tl / ta)
    cr = F.when((n("current_assets") != 0) & (n("current_liabilities") > 0), n("current_assets") / n("current_liabilities"))
    sheet = ladder(dr, [(0.5, 2.0), (0.7, 1.0)], op="<") + ladder(cr, [(2.0, 2.0), (1.5, 1.0)])
    cash = flag(n("free_cash_flow") > 0, 2.0) + flag(n("dividends_and_other_cash_distributions") < 0)
    iss = n("issuance_or_purchase_of_equity_shares")
    mgmt = F.when(iss < 0, 2.0).when(iss == 0, 1.0).otherwise(0.0)
    roe_q = F.when(both & (n0 != 0), F.when(eq > 0, ladder(n0 / eq, [(0.20, 1.0), (0.15, 0.8), (0.10, 0.6)], 0.3)).otherwise(0.0)).otherwise(0.5)
    debt_q = F.when(both, ladder(tl / ta, [(0.3, 1.0), (0.5, 0.7), (0.7, 0.4)], 0.1, "<")).otherwise(0.5)
    ni4 = positive("net_income", 4)
    quality = (roe_q + debt_q + F.when(F.size(ni4) >= 3, _not_falling(ni4, compat)).otherwise(0.5)) / 3
    p = p.select("symbol", profit.alias("profitability"), growth.alias("growth"), sheet.alias("balance_sheet"), cash.alias("cash_flow"), mgmt.alias("management"),
                 quality.alias("_q"), n0.alias("_ni"), n("market_cap").alias("_cap"), F.size(ni).alias("_k"), P.cagr(ni).alias("_h"))
    h, q = F.col("_h"), F.col("_q")
    g = F.when(h > 0.25, 0.20).when(h > 0.15, h * 0.8).when(h > 0.05, h * 0.9).otherwise(0.05)
    rate, mult = F.when(q >= 0.8, 0.12).when(q >= 0.6, 0.15).otherwise(0.18), F.when(q >= 0.8, 18.0).when(q >= 0.6, 15.0).otherwise(12.0)
    p = p.withColumn("_g", g).withColumn("_r", rate).withColumn("_m", mult)
    full = P.pv(F.col("_ni"), F.col("_g"), F.col("_r"), 5) + F.col("_ni") * F.pow(1 + F.col("_g"), F.lit(5)) * F.col("_m") / F.pow(1 + F.col("_r"), F.lit(5))
    iv = F.when(F.col("_ni") > 0, F.when(F.col("_k") < 2, F.col("_ni") * 12).otherwise(full))
    p = p.withColumn("margin_of_safety", F.when((iv != 0) & (F.col("_cap") != 0), (iv - F.col("_cap")) / F.col("_cap")))
    parts = ["profitability", "growth", "balance_sheet", "cash_flow", "management"]
    p = p.withColumn("score", sum((F.col(c) for c in parts), F.lit(0.0)))
    mos, sc = F.col("margin_of_safety"), F.col("score")
    sig = (F.when(mos >= 0.30, "bullish").when(mos <= -0.30, "bearish").when((q >= 0.7) & (sc >= 24 * 0.6), "bullish")
           .when((q <= 0.4) | (sc <= 24 * 0.3), "bearish").otherwise("neutral"))
    return p.select("symbol", *parts, "score", F.lit(24.0).alias("max_score"), "margin_of_safety", q.alias("quality"), sig.alias("signal"))


def screen_buffett(panel, as_of):
    """Quality score and margin of safety; the published rule leaves the signal to judgement, and its
    maximum of 27 does not count the three consistency points."""
    n = P.now
    p = P.profile(panel, as_of, 10)
    fundamentals = flag(n("return_on_equity") > 0.15, 2.0) + flag((n("debt_to_equity") != 0) & (n("debt_to_equity") < 0.5), 2.0) + flag(n("operating_margin") > 0.15, 2.0) + flag(n("current_ratio") > 1.5)
    ni = P.series("net_income", True)
    _, _, rising = P.consistency(ni)
    consistency = flag((F.col("_n") >= 4) & (F.size(ni) >= 4) & rising, 3.0)
    roe, om, at = P.series("return_on_equity"), P.series("operating_margin"), P.series("asset_turnover")
    share = P.count_if(roe, lambda v: v > 0.15) / F.size(roe)
    old3 = P.mean(F.slice(F.reverse(om), 1, 3))

    def stable(a):
        return F.when(P.mean(a) > 0, 1 - P.std(a) / P.mean(a)).otherwise(0.0)

    five_r, five_m = F.size(roe) >= 5, F.size(om) >= 5
    moat = (F.when(five_r, ladder(share, [(0.8, 2.0), (0.6, 1.0)], op=">=")).otherwise(0.0)
            + flag(five_m & (P.mean(om) > 0.2) & (P.recent_mean(om, 3) >= old3))
            + flag((F.size(at) >= 3) & (P.count_if(at, lambda v: v > 1.0) > 0)) + flag(five_r & five_m & ((stable(roe) + stable(om)) / 2 > 0.7)))
    moat = F.when(F.col("_n") >= 5, F.least(moat, F.lit(5.0))).otherwise(0.0)
    mgmt = flag(n("issuance_or_purchase_of_equity_shares") < 0) + flag(n("dividends_and_other_cash_distributions") < 0)
    gm = P.series("gross_margin")
    new2, old2 = P.recent_mean(gm, 2), P.mean(F.slice(F.reverse(gm), 1, 2))
    pricing = (F.when(F.size(gm) >= 3, F.when(new2 > old2 + 0.02, 3.0).when(new2 > old2, 2.0).when(F.abs(new2 - old2) < 0.01, 1.0).otherwise(0.0)).otherwise(0.0)
               + ladder(P.mean(gm), [(0.5, 2.0), (0.3, 1.0)]))
    bv = F.filter(F.transform("_p", lambda x: F.when((x["shareholders_equity"] != 0) & (x["outstanding_shares"] != 0), x["shareholders_equity"] / x["outstanding_shares"])), lambda v: v.isNotNull())
    up, adj, _ = P.consistency(bv)
    from_negative = (P.last(bv) < 0) & (P.first(bv) > 0)
    book = F.when((F.col("_n") >= 3) & (F.size(bv) >= 3), ladder(up / adj, [(0.8, 3.0), (0.6, 2.0), (0.4, 1.0)], op=">=")
                  + F.when(from_negative, 3.0).otherwise(ladder(P.cagr(bv), [(0.15, 2.0), (0.1, 1.0)]))).otherwise(0.0)
    # maintenance spending: the median of three estimates, or the larger of two
    five = F.slice("_p", 1, 5)
    ratios = F.filter(F.transform(five, lambda x: F.when((x["capital_expenditure"] != 0) & (x["revenue"] > 0), F.abs(x["capital_expenditure"]) / x["revenue"])), lambda v: v.isNotNull())
    m1, m2, m3 = nz(F.abs(n("capital_expenditure"))) * 0.85, nz(n("depreciation_and_amortization")), P.mean(ratios) * nz(n("revenue"))
    spend = F.when(F.size(ratios) >= 3, F.get(F.array_sort(F.array(m1, m2, m3)), F.lit(1))).otherwise(F.greatest(m1, m2))
    prev = F.get(F.col("_p"), F.lit(1))
    wc = nz((n("current_assets") - n("current_liabilities")) - (prev["current_assets"] - prev["current_liabilities"]))
    oe = n("net_income") + n("depreciation_and_amortization") - F.when(n("capital_expenditure").isNotNull(), spend) - wc
    ni5 = F.filter(F.transform(five, lambda x: x["net_income"]), lambda v: v.isNotNull() & (v != 0))
    grown = F.when((F.size(ni5) >= 3) & (P.last(ni5) > 0), F.greatest(F.lit(-0.05), F.least(F.when(P.first(ni5) > 0, F.pow(P.first(ni5) / P.last(ni5), 1.0 / (F.size(ni5) - 1)) - 1).otherwise(-1.0), F.lit(0.15))) * 0.7).otherwise(0.03)
    ok = (F.col("_n") >= 3) & (oe != 0) & (n("outstanding_shares") > 0)
    p = p.select("symbol", fundamentals.alias("fundamentals"), consistency.alias("consistency"), moat.alias("moat"), pricing.alias("pricing_power"), book.alias("book_value"), mgmt.alias("management"),
                 F.when(ok, oe).alias("owner_earnings"), grown.alias("_g"), n("market_cap").alias("_cap"))
    g1, g2, o = F.least("_g", F.lit(0.08)), F.least(F.col("_g") * 0.5, F.lit(0.04)), F.col("owner_earnings")
    end1 = o * F.pow(1 + g1, F.lit(5))
    iv = (P.pv(o, g1, 0.10, 5) + P.pv(end1, g2, 0.10, 5) / 1.1 ** 5 + end1 * F.pow(1 + g2, F.lit(5)) * 1.025 / 0.075 / 1.1 ** 10) * 0.85
    parts = ["fundamentals", "consistency", "moat", "pricing_power", "book_value", "management"]
    return p.select("symbol", *parts, sum((F.col(c) for c in parts), F.lit(0.0)).alias("score"), F.lit(27.0).alias("max_score"), "owner_earnings",
                    F.when((iv != 0) & (F.col("_cap") != 0), (iv - F.col("_cap")) / F.col("_cap")).alias("margin_of_safety"))


def screen_munger(panel, insider, as_of, compat=False):
    """Moat, management, predictability and price, with flags and a bounded confidence.

    Gross margins count as improving when the newer is at least the older (``compat``: the reverse);
    insider buys and sells are read off the sign of the shares.
    """
    n = P.now
    p = P.profile(panel, as_of, 10).join(aggs.insider_flow(insider, as_of).select("symbol", "buys", "sells", "buy_ratio"), "symbol", "left")
    roic, gm, om, oi = P.series("return_on_invested_capital"), P.series("gross_margin"), P.series("operating_margin"), P.series("operating_income")
    rev, fcf, ni = P.series("revenue"), P.series("free_cash_flow"), P.series("net_income")
    hits = P.count_if(roic, lambda v: v > 0.15)
    r = F.when(F.size(roic) > 0, F.when(hits >= F.size(roic) * 0.8, 3.0).when(hits >= F.size(roic) * 0.5, 2.0).when(hits > 0, 1.0).otherwise(0.0)).otherwise(0.0)
    prev = F.slice(gm, 2, F.greatest(F.size(gm) - 1, F.lit(0)))
    ups = F.size(F.filter(F.zip_with(F.slice(gm, 1, F.size(prev)), prev, lambda c, q: (q >= c) if compat else (c >= q)), lambda v: v))
    pricing = F.when(F.size(gm) >= 3, F.when(ups >= F.size(gm) * 0.7, 2.0).when(P.mean(gm) > 0.3, 1.0).otherwise(0.0)).otherwise(0.0)
    light = F.filter(F.transform("_p", lambda x: F.when(x["revenue"] > 0, F.abs(x["capital_expenditure"]) / x["revenue"])), lambda v: v.isNotNull())
    lean = F.when(F.col("_n") >= 3, ladder(P.mean(light), [(0.05, 2.0), (0.10, 1.0)], op="<")).otherwise(0.0)
    rd, gw = P.series("research_and_development"), P.series("goodwill_and_intangible_assets")
    moat = F.least(F.lit(10.0), (r + pricing + lean + flag((F.size(rd) > 0) & (P.total(rd) > 0)) + flag(F.size(gw) > 0)) * 10 / 9)
    conv = F.filter(F.zip_with(fcf, ni, lambda a, b: F.when(b > 0, a / b)), lambda v: v.isNotNull())
    quality = F.when((F.size(fcf) > 0) & (F.size(fcf) == F.size(ni)), ladder(P.mean(conv), [(1.1, 3.0), (0.9, 2.0), (0.7, 1.0)])).otherwise(0.0)
    debt, eq, sh = P.series("total_debt"), P.series("shareholders_equity"), P.series("outstanding_shares")
    de = F.when((F.size(debt) > 0) & (F.size(debt) == F.size(eq)), F.when(P.first(eq) > 0, P.first(debt) / P.first(eq)).otherwise(F.lit(float("inf"))))
    cr = safe_div(P.first(P.series("cash_and_equivalents")), P.first(rev))
    cash = F.when((cr >= 0.1) & (cr <= 0.25), 2.0).when(((cr >= 0.05) & (cr < 0.1)) | ((cr > 0.25) & (cr <= 0.4)), 1.0).otherwise(0.0)
    br = F.col("buy_ratio")
    ins = F.when(br > 0.7, 2.0).when(br > 0.4, 1.0).when((br < 0.1) & (F.col("sells") > 5), -1.0).otherwise(0.0)
    s0, s1 = P.first(sh), P.last(sh)
    count = F.when(F.size(sh) >= 3, F.when(s0 < s1 * 0.95, 2.0).when(s0 < s1 * 1.05, 1.0).when(s0 > s1 * 1.2, -1.0).otherwise(0.0)).otherwise(0.0)
    mgmt = F.greatest(F.lit(0.0), F.least(F.lit(10.0), (quality + ladder(de, [(0.3, 3.0), (0.7, 2.0), (1.5, 1.0)], op="<") + cash + ins + count) * 10 / 12))
    gr = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(rev) - 1, F.lit(1))), lambda i: F.try_divide(F.get(rev, i - 1), F.get(rev, i)) - 1), lambda v: v.isNotNull())
    ag, gv = P.mean(gr), P.stability(gr, "mad")
    grow = F.when(F.size(rev) >= 5, F.when((ag > 0.05) & (gv < 0.1), 3.0).when((ag > 0) & (gv < 0.2), 2.0).when(ag > 0, 1.0).otherwise(0.0)).otherwise(0.0)
    pos, posf = P.count_if(oi, lambda v: v > 0), P.count_if(fcf, lambda v: v > 0)
    ops = F.when(F.size(oi) >= 5, F.when(pos == F.size(oi), 3.0).when(pos >= F.size(oi) * 0.8, 2.0).when(pos >= F.size(oi) * 0.6, 1.0).otherwise(0.0)).otherwise(0.0)
    calm = F.when(F.size(om) >= 5, ladder(P.stability(om, "mad"), [(0.03, 2.0), (0.07, 1.0)], op="<")).otherwise(0.0)
    flow = F.when(F.size(fcf) >= 5, F.when(posf == F.size(fcf), 2.0).when(posf >= F.size(fcf) * 0.8, 1.0).otherwise(0.0)).otherwise(0.0)
    predict = F.when(F.col("_n") >= 5, F.least(F.lit(10.0), grow + ops + calm + flow)).otherwise(0.0)
    cap, norm = n("market_cap"), P.recent_mean(fcf, 5)
    y = F.when((F.size(fcf) >= 3) & (norm > 0) & (cap > 0), norm / cap)
    mos = F.when(y.isNotNull(), (norm * 15 - cap) / cap)
    recent, old = P.recent_vs_old(fcf, 3)
    value = F.when(y.isNotNull(), F.least(F.lit(10.0), ladder(y, [(0.08, 4.0), (0.05, 3.0), (0.03, 1.0)]) + ladder(mos, [(0.3, 3.0), (0.1, 2.0), (-0.1, 1.0)])
                                          + F.when(recent > old * 1.2, 3.0).when(recent > old, 2.0).otherwise(0.0))).otherwise(0.0)
    p = p.select("symbol", moat.alias("moat"), mgmt.alias("management"), predict.alias("predictability"), value.alias("valuation"), mos.alias("margin_of_safety"), y.alias("fcf_yield"),
                 nz(br).alias("_br"), de.alias("_de"), cr.alias("_cr"), F.coalesce((F.size(sh) >= 3) & (s0 < s1 * 0.95), F.lit(False)).alias("share_count_friendly"))
    c = F.col
    p = p.withColumn("score", c("moat") * 0.35 + c("management") * 0.25 + c("predictability") * 0.25 + c("valuation") * 0.15).withColumn("max_score", F.lit(10.0))
    p = p.withColumn("signal", band(c("score"), 7.5, 5.5))
    q = 100 * (0.35 * c("moat") + 0.25 * c("management") + 0.25 * c("predictability")) / 8.5
    m = nz(c("margin_of_safety"))
    raw = 0.85 * q + 0.15 * c("valuation") * 10 + F.greatest(F.lit(-10.0), F.least(F.lit(10.0), m * 100 / 3))
    bull, bear = c("signal") == "bullish", c("signal") == "bearish"
    hi = F.when(bull, F.when(m > 0, 100.0).otherwise(69.0)).when(bear, 49.0).otherwise(69.0)
    lo = F.when(bull, F.when(q >= 55, 50.0).otherwise(30.0)).when(bear, F.when(m < -0.05, 10.0).otherwise(30.0)).otherwise(50.0)
    conf = F.bround(F.greatest(lo, F.least(hi, raw)), 0)
    r2 = {k: F.bround(c(k), 2) for k in ("moat", "management", "predictability")}
    return p.select(
        "symbol", "moat", "management", "predictability", "valuation", "score", "max_score", "signal", conf.alias("confidence"), "margin_of_safety", "fcf_yield",
        (r2["moat"] >= 7).alias("moat_strong"), (r2["predictability"] >= 7).alias("predictable"), ((r2["management"] >= 7) | (c("_br") >= 0.6)).alias("owner_aligned"),
        F.coalesce(c("_de") < 0.7, F.lit(False)).alias("low_leverage"), F.coalesce((c("_cr") >= 0.1) & (c("_cr") <= 0.25), F.lit(False)).alias("sensible_cash"),
        (m > 0).alias("mos_positive"), (nz(c("fcf_yield")) >= 0.05).alias("fcf_yield_ok"), "share_count_friendly")


# -- running a selection ----------------------------------------------------------------

SCREENS = {
    "technical": lambda i: screen_technical(i["bars"]),
    "fundamentals": lambda i: screen_fundamentals(i["panel"], i["as_of"]),
    "growth": lambda i: screen_growth(i["panel"], i["insider"], i["as_of"]),
    "sentiment": lambda i: screen_sentiment(i["insider"], i["news"], i["as_of"]),
    "graham": lambda i: screen_graham(i["panel"], i["as_of"]),
    "ackman": lambda i: screen_ackman(i["panel"], i["as_of"]),
    "wood": lambda i: screen_wood(i["panel"], i["as_of"]),
    "burry": lambda i: screen_burry(i["panel"], i["insider"], i["news"], i["as_of"]),
    "lynch": lambda i: screen_lynch(i["panel"], i["insider"], i["news"], i["as_of"], i.get("words")),
    "pabrai": lambda i: screen_pabrai(i["panel"], i["as_of"]),
    "munger": lambda i: screen_munger(i["panel"], i["insider"], i["as_of"]),
    "fisher": lambda i: screen_fisher(i["panel"], i["insider"], i["news"], i["as_of"], i.get("words")),
    "druckenmiller": lambda i: screen_druckenmiller(i["panel"], i["bars"], i["insider"], i["news"], i["as_of"], i.get("words")),
    "damodaran": lambda i: screen_damodaran(i["panel"], i["as_of"]),
    "jhunjhunwala": lambda i: screen_jhunjhunwala(i["panel"], i["as_of"]),
}


def run_screens(names, inputs):
    """Long (analyst, symbol, signal) of the selected screens; unknown names raise KeyError."""
    parts = [SCREENS[n](inputs).select(F.lit(n).alias("analyst"), "symbol", "signal") for n in names]
    return reduce(lambda a, b: a.unionByName(b), parts)


def compact_signals(signals):
    """Signals with both a side and a confidence, without the risk manager's rows."""
    return signals.dropna(subset=["signal", "confidence"]).filter(~F.col("analyst").startswith("risk_management_agent"))
