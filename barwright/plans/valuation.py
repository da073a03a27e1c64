"""Valuation models for every symbol of a fundamentals panel at once."""

from pyspark.sql import functions as F

from barwright.functions.numeric import clamp, safe_div
from barwright.operators import panel as P



def _z():
    return F.lit(0.0)


def owner_earnings_value(growth, rate=0.15, margin=0.25, years=5):
    wc_now, wc_prev = P.now("working_capital"), F.get(F.col("_p"), F.lit(1))["working_capital"]
    wc = F.coalesce(wc_now - wc_prev, _z())
    oe = P.now("net_income") + P.now("depreciation_and_amortization") - P.now("capital_expenditure") - wc
    end = F.least(growth, F.lit(0.03))
    term = oe * F.pow(1 + growth, F.lit(years)) * (1 + end) / (rate - end) / (1 + rate) ** years
    return F.when(oe > 0, (P.pv(oe, growth, F.lit(rate), years) + term) * (1 - margin)).otherwise(0.0)


def dcf_value(fcf, g=0.05, r=0.10, t=0.02, years=5):
    term = fcf * (1 + g) ** years * (1 + t) / (r - t) / (1 + r) ** years
    return F.when(fcf > 0, P.pv(fcf, F.lit(g), F.lit(r), years) + term).otherwise(0.0)


def ev_ebitda_value():
    ev, mult = P.now("enterprise_value"), P.now("enterprise_value_to_ebitda_ratio")
    med = P.median(P.series("enterprise_value_to_ebitda_ratio", nonzero=True))
    implied = med * safe_div(ev, mult) - (ev - F.coalesce(P.now("market_cap"), _z()))
    return F.when((ev != 0) & (mult != 0), F.greatest(implied, _z())).otherwise(0.0)


def residual_income_value(growth, coe=0.10, t=0.03, years=5):
    cap, ni, pb = P.now("market_cap"), P.now("net_income"), P.now("price_to_book_ratio")
    book = safe_div(cap, pb)
    ri = ni - coe * book
    term = ri * F.pow(1 + growth, F.lit(years + 1)) / (coe - t) / (1 + coe) ** years
    ok = (cap != 0) & (ni != 0) & (pb > 0) & (ri > 0)
    return F.when(ok, (book + P.pv(ri, growth, F.lit(coe), years) + term) * 0.8).otherwise(0.0)


def wacc(rf=0.045, premium=0.06, beta=1.0):
    cov = P.now("interest_coverage")
    coe = rf + beta * premium
    cod = F.when(cov > 0, F.greatest(F.lit(rf + 0.01), rf + 10 / cov)).otherwise(rf + 0.05)
    cap = F.coalesce(P.now("market_cap"), _z())
    debt = F.greatest(F.coalesce(P.now("total_debt"), _z()) - F.coalesce(P.now("cash_and_equivalents"), _z()), _z())
    all_ = cap + debt
    return clamp(F.when(all_ > 0, cap / all_ * coe + debt / all_ * cod * 0.75).otherwise(coe), 0.06, 0.20)


def fcf_volatility(a):
    pos = F.filter(a, lambda v: v > 0)
    return F.when(F.size(a) < 3, 0.5).when(F.size(pos) < 2, 0.8).otherwise(F.coalesce(P.stability(pos, "capped"), F.lit(0.8)))


def enhanced_dcf(a, rate, growth, cap):
    """Three-stage DCF on newest-first cash flows, scaled down by their volatility."""
    base = F.greatest(P.first(a), P.recent_mean(a, 3) * 0.85)
    high = F.when(growth != 0, F.least(growth, F.lit(0.25))).otherwise(0.05)
    high = F.when(cap > 50_000_000_000, F.least(high, F.lit(0.10))).otherwise(high)
    mid = (high + 0.03) / 2
    end = F.least(F.lit(0.03), high * 0.6)
    end = F.when(rate <= end, rate * 0.8).otherwise(end)
    grown = base * F.pow(1 + high, F.lit(3))
    stage2 = F.aggregate(F.sequence(F.lit(4), F.lit(7)), F.lit(0.0),
                         lambda s, y: s + grown * F.pow(1 + mid * (8 - y) / 4, y - 3) / F.pow(1 + rate, y))
    term = grown * F.pow(1 + mid, F.lit(4)) * (1 + end) / (rate - end) / F.pow(1 + rate, F.lit(7))
    quality = F.greatest(F.lit(0.7), 1 - fcf_volatility(a) * 0.5)
    return F.when(P.first(a) > 0, (P.pv(base, high, rate, 3) + stage2 + term) * quality).otherwise(0.0)


# Scenario name, growth and discount adjustments, probability.
SCENARIOS = [("bear", 0.5, 1.2, 0.2), ("base", 1.0, 1.0, 0.6), ("bull", 1.5, 0.9, 0.2)]


def valuations(panel, as_of, periods=8):
    """All model values per symbol with at least two periods."""
    p = P.profile(panel, as_of, periods).filter(F.col("_n") >= 2)
    growth = F.when(P.now("earnings_growth") != 0, P.now("earnings_growth")).otherwise(0.05)
    book = F.when(P.now("book_value_growth") != 0, P.now("book_value_growth")).otherwise(0.03)
    rev = F.when(P.now("revenue_growth") != 0, P.now("revenue_growth")).otherwise(0.05)
    cap = F.coalesce(P.now("market_cap"), _z())
    p = p.select(
        "symbol", "_p", P.now("market_cap").alias("market_cap"), owner_earnings_value(growth).alias("owner_earnings"),
        dcf_value(P.now("free_cash_flow")).alias("simple_dcf"), ev_ebitda_value().alias("ev_ebitda"),
        residual_income_value(book).alias("residual_income"), wacc().alias("wacc"), rev.alias("_rev"),
        P.series("free_cash_flow").alias("_fcf"))
    for name, g, w, _ in SCENARIOS:
        p = p.withColumn(f"dcf_{name}", enhanced_dcf(F.col("_fcf"), F.col("wacc") * w, F.col("_rev") * g, cap))
    expected = sum((F.col(f"dcf_{n}") * pr for n, _, _, pr in SCENARIOS), _z())
    return p.withColumn("dcf", expected).withColumn("fcf_volatility", fcf_volatility(F.col("_fcf"))).drop("_p", "_rev", "_fcf")


# Weight of each method.
METHODS = {"dcf": 0.35, "owner_earnings": 0.35, "ev_ebitda": 0.20, "residual_income": 0.10}


def screen_valuation(panel, as_of):
    """Weighted gap of the positive methods to market cap; +-15 % decides."""
    v = valuations(panel, as_of).filter((F.col("market_cap") != 0) & F.col("market_cap").isNotNull())
    weight = sum((F.when(F.col(m) > 0, w).otherwise(0.0) for m, w in METHODS.items()), _z())
    gap = sum((F.when(F.col(m) > 0, w * (F.col(m) - F.col("market_cap")) / F.col("market_cap")).otherwise(0.0) for m, w in METHODS.items()), _z())
    v = v.withColumn("_w", weight).filter(F.col("_w") > 0).withColumn("weighted_gap", gap / F.col("_w"))
    sig = F.when(F.col("weighted_gap") > 0.15, "bullish").when(F.col("weighted_gap") < -0.15, "bearish").otherwise("neutral")
    return v.select("symbol", *METHODS, "market_cap", "weighted_gap", sig.alias("signal"),
                    F.bround(F.least(F.abs("weighted_gap") / 0.30 * 100, F.lit(100.0)), 0).alias("confidence"))
