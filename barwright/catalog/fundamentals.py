"""Registered panel statistics, valuations and screens."""

from pyspark.sql import functions as F

from barwright.catalog.indicators import ADX, BARS, NUM, RET, W_, _lags, ema_sql, roll
from barwright.catalog.registry import he, query, r, rcols, tidy
from barwright.catalog.sqlframes import AS_OF, BRAND_BARS, BRAND_NEWS_AT, BRAND_NEWS_YEAR, INSIDER, INSIDER_AT, INSIDER_YEAR, PANEL, SIGNALS, profile
from barwright.operators import aggs, joins, panel as P
from barwright.plans import screens, valuation
from barwright.sources import frames, universe



def pan(spark, sf):
    return frames.panel(spark, sf)


@query("p03_latest_periods", f"""WITH {PANEL}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY report_period DESC) AS rn FROM panel WHERE report_period <= DATE '1999-05-15')
  SELECT symbol, report_period, {rcols('revenue net_income market_cap', 2)}, {rcols('revenue_growth return_on_equity peg_ratio', 4)} FROM k WHERE rn <= 4""")
def _(spark, sf):
    p = P.latest_periods(pan(spark, sf), "1999-05-15", 4)
    return p.select("symbol", "report_period", *[F.round(c, 2).alias(c) for c in ("revenue", "net_income", "market_cap")],
                    *[F.round(c, 4).alias(c) for c in ("revenue_growth", "return_on_equity", "peg_ratio")])


@query("j02_asof_join", f"""WITH {PANEL}, {BRAND_BARS} SELECT b.symbol, b.ts, {r('b.close', 4)} AS close, p.report_period AS ts_right, {r('p.revenue', 2)} AS revenue
  FROM brand_bars b ASOF LEFT JOIN panel p ON b.symbol = p.symbol AND b.ts >= p.report_period""")
def _(spark, sf):
    p = pan(spark, sf).withColumnRenamed("report_period", "ts")
    j = joins.asof_join(frames.brand_bars(spark, sf), p, ["symbol"], "ts", ["revenue"])
    return j.select("symbol", "ts", F.round("close", 4).alias("close"), "ts_right", F.round("revenue", 2).alias("revenue"))


@query("j13_market_cap", f"""WITH {PANEL}, m AS (SELECT symbol, arg_max(market_cap, report_period) AS m FROM panel GROUP BY 1),
  i AS (SELECT p_brand AS symbol, CASE WHEN count(*) % 3 = 0 THEN 0 WHEN count(*) % 3 = 1 THEN NULL ELSE sum(p_retailprice) END AS c FROM part GROUP BY 1)
  SELECT symbol, {r('coalesce(nullif(c, 0), nullif(m, 0))', 2)} AS market_cap FROM i LEFT JOIN m USING (symbol)""")
def _(spark, sf):
    n = F.count(F.lit(1)) % 3
    info = frames.table(spark, sf, "part").groupBy(F.col("p_brand").alias("symbol")).agg(
        F.when(n == 0, 0.0).when(n == 1, None).otherwise(F.sum("p_retailprice")).alias("market_cap"))
    return tidy(joins.market_cap(info, pan(spark, sf)), 2)


@query("a29_insider_flow", f"""WITH {INSIDER} SELECT symbol, buys, sells, {rcols('net_shares bought sold buy_value sell_value', 2)},
  {r('coalesce((buy_value - sell_value) / nullif(buy_value + sell_value, 0), 0)', 4)} AS net_flow_ratio, {r('buys / nullif(buys + sells, 0)', 4)} AS buy_ratio FROM flow""")
def _(spark, sf):
    f = aggs.insider_flow(frames.insider(spark, sf)).drop("trades", "non_sales")
    return tidy(f, 4)


L = {  # list idioms of the oracle
    "mean": lambda a: f"list_avg({a})",
    "growth": lambda a: f"CASE WHEN len({a}) >= 2 THEN ({a}[1] - {a}[-1]) / nullif(abs({a}[-1]), 0) END",
    "cagr": lambda a: f"CASE WHEN len({a}) >= 2 AND {a}[-1] > 0 AND {a}[1] > 0 THEN power({a}[1] / {a}[-1], 1.0 / (len({a}) - 1)) - 1 END",
    "major": lambda a, c: f"(len({a}) > 0 AND len(list_filter({a}, lambda v: {c})) >= len({a}) // 2 + 1)",
    "slope": lambda a: f"""CASE WHEN len({a}) >= 2 THEN (len({a}) * list_sum(list_transform({a}, lambda v, i: v * (i - 1))) - (len({a}) * (len({a}) - 1) / 2) * list_sum({a}))
        / (len({a}) * ((len({a}) - 1) * len({a}) * (2 * len({a}) - 1) / 6) - power(len({a}) * (len({a}) - 1) / 2, 2)) ELSE 0 END""",
    "gs": lambda a: f"list_transform(range(1, len({a})), lambda i: ({a}[i] - {a}[i + 1]) / nullif(abs({a}[i + 1]), 0))",
    "old": lambda a: f"CASE WHEN len({a}) >= 6 THEN list_avg({a}[-3:]) ELSE {a}[-1] END",
}
PROF = {n: f"WITH {PANEL}, {profile(n)}" for n in (1, 5, 8, 10, 12)}


def prof(spark, sf, n):
    return P.profile(pan(spark, sf), AS_OF, n)


@query("a23_trend_slope", f"{PROF[12]} SELECT symbol, {r(L['slope']('revenue_growth'))} AS revenue_slope, {r(L['slope']('gross_margin'))} AS margin_slope FROM prof")
def _(spark, sf):
    return tidy(prof(spark, sf, 12).select("symbol", P.trend_slope(P.series("revenue_growth")).alias("revenue_slope"), P.trend_slope(P.series("gross_margin")).alias("margin_slope")))


@query("a24_cagr", f"{PROF[8]} SELECT symbol, {r(L['cagr']('revenue'))} AS revenue_cagr, {r(L['cagr']('earnings_per_share'))} AS eps_cagr FROM prof")
def _(spark, sf):
    return tidy(prof(spark, sf, 8).select("symbol", P.cagr(P.series("revenue")).alias("revenue_cagr"), P.cagr(P.series("earnings_per_share")).alias("eps_cagr")))


@query("a25_total_growth", f"{PROF[8]} SELECT symbol, {r(L['growth']('revenue'))} AS revenue_growth, {r(L['growth']('free_cash_flow'))} AS fcf_growth FROM prof")
def _(spark, sf):
    return tidy(prof(spark, sf, 8).select("symbol", P.total_growth(P.series("revenue")).alias("revenue_growth"), P.total_growth(P.series("free_cash_flow")).alias("fcf_growth")))


@query("a26_medians", f"""{PROF[8]} SELECT symbol, {r('list_median(price_to_earnings_ratio)', 4)} AS median_pe, {r('list_sort(price_to_earnings_ratio)[len(price_to_earnings_ratio) // 2 + 1]', 4)} AS upper_median_pe FROM prof""")
def _(spark, sf):
    a = P.series("price_to_earnings_ratio")
    return tidy(prof(spark, sf, 8).select("symbol", P.median(a).alias("median_pe"), P.upper_median(a).alias("upper_median_pe")), 4)


_om = "operating_margin"
_mad = f"list_avg(list_transform({_om}, lambda v: abs(v - list_avg({_om}))))"


@query("a27_stability", f"""{PROF[8]} SELECT symbol, {r(f'list_stddev_pop({_om}) / abs(list_avg({_om}))', 4)} AS cv, {r(f'list_stddev_pop({_om})')} AS sd, {r(_mad)} AS mad,
  {r('CASE WHEN list_avg(revenue) > 0 THEN least(list_stddev_samp(revenue) / list_avg(revenue), 1) END')} AS capped FROM prof""")
def _(spark, sf):
    a = P.series(_om)
    s = prof(spark, sf, 8).select("symbol", F.round(P.stability(a, "cv"), 4).alias("cv"), P.stability(a, "std").alias("sd"), P.stability(a, "mad").alias("mad"), P.stability(P.series("revenue"), "capped").alias("capped"))
    return tidy(s)


@query("a28_hit_ratio", f"""{PROF[10]} SELECT symbol, CAST(len(list_filter(return_on_equity, lambda v: v > 0.15)) AS BIGINT) AS roe_hits, len(return_on_equity)::BIGINT AS roe_known,
  {L['major']('return_on_equity', 'v > 0.15')} AS roe_majority, {L['major']('free_cash_flow', 'v > 0')} AS fcf_majority FROM prof""")
def _(spark, sf):
    a = P.series("return_on_equity")
    return tidy(prof(spark, sf, 10).select("symbol", P.count_if(a, lambda v: v > 0.15).alias("roe_hits"), F.size(a).alias("roe_known"),
                                           P.majority(a, lambda v: v > 0.15).alias("roe_majority"), P.majority(P.series("free_cash_flow"), lambda v: v > 0).alias("fcf_majority")))


@query("a41_recent_vs_old", f"{PROF[8]} SELECT symbol, {r('list_avg(free_cash_flow[1:3])', 2)} AS recent, {r(L['old']('free_cash_flow'), 2)} AS old FROM prof")
def _(spark, sf):
    a, b = P.recent_vs_old(P.series("free_cash_flow"), 3)
    return tidy(prof(spark, sf, 8).select("symbol", a.alias("recent"), b.alias("old")), 2)


@query("w22_growth_series", f"""{PROF[8]}, g AS (SELECT symbol, {L['gs']('revenue')} AS g FROM prof) SELECT symbol, {r('g[1]')} AS newest, {r('g[-1]')} AS oldest, {r('g[1] - g[-1]')} AS acceleration, len(g)::BIGINT AS n FROM g""")
def _(spark, sf):
    g, a = P.growth_series(P.series("revenue")), P.acceleration(P.series("revenue"))
    return tidy(prof(spark, sf, 8).select("symbol", P.first(g).alias("newest"), P.last(g).alias("oldest"), a.alias("acceleration"), F.size(g).alias("n")))


@query("w23_growth_consistency", f"""{PROF[8]}, u AS (SELECT symbol, len(list_filter(range(1, len(net_income)), lambda i: net_income[i] > net_income[i + 1]))::BIGINT AS ups, (len(net_income) - 1)::BIGINT AS n FROM prof)
  SELECT symbol, ups, n, n > 0 AND ups = n AS monotonic FROM u""")
def _(spark, sf):
    k, n, m = P.consistency(P.series("net_income"))
    return tidy(prof(spark, sf, 8).select("symbol", k.alias("ups"), n.alias("n"), m.alias("monotonic")))


# -- valuation --------------------------------------------------------------------------

def pv_sql(base, g, rate, n):
    return "(" + " + ".join(f"{base} * power(1 + {g}, {y}) / power(1 + {rate}, {y})" for y in range(1, n + 1)) + ")"


def edcf_sql(w, a):
    mid = "(high + 0.03) / 2"
    st2 = " + ".join(f"base * power(1 + high, 3) * power(1 + {mid} * {8 - y} / 4, {y - 3}) / power(1 + w, {y})" for y in range(4, 8))
    return f"""(SELECT CASE WHEN f0 > 0 THEN ({pv_sql('base', 'high', 'w', 3)} + {st2}
        + base * power(1 + high, 3) * power(1 + {mid}, 4) * (1 + te) / (w - te) / power(1 + w, 7)) * greatest(0.7, 1 - vol * 0.5) ELSE 0 END
      FROM (SELECT *, CASE WHEN w <= least(0.03, high * 0.6) THEN w * 0.8 ELSE least(0.03, high * 0.6) END AS te FROM
        (SELECT f0, vol, greatest(f0, f3 * 0.85) AS base, wacc * {w} AS w, CASE WHEN cap > 5e10 THEN least(h, 0.10) ELSE h END AS high FROM (SELECT least(rg * {a}, 0.25) AS h))))"""


VALS = f"""{PROF[8]}, v0 AS (SELECT symbol, market_cap_0 AS cap, free_cash_flow[1] AS f0, list_avg(free_cash_flow[1:3]) AS f3,
    CASE WHEN len(free_cash_flow) < 3 THEN 0.5 WHEN len(list_filter(free_cash_flow, lambda v: v > 0)) < 2 THEN 0.8
      ELSE least(list_stddev_samp(list_filter(free_cash_flow, lambda v: v > 0)) / list_avg(list_filter(free_cash_flow, lambda v: v > 0)), 1.0) END AS vol,
    coalesce(nullif(earnings_growth_0, 0), 0.05) AS eg, coalesce(nullif(book_value_growth_0, 0), 0.03) AS bg, coalesce(nullif(revenue_growth_0, 0), 0.05) AS rg,
    net_income_0 + depreciation_and_amortization_0 - capital_expenditure_0 - (working_capital[1] - working_capital[2]) AS oe, free_cash_flow_0 AS fcf, net_income_0 AS ni,
    enterprise_value_0 AS ev, enterprise_value_to_ebitda_ratio_0 AS mult, list_median(enterprise_value_to_ebitda_ratio) AS med, price_to_book_ratio_0 AS pb,
    greatest(coalesce(total_debt_0, 0) - coalesce(cash_and_equivalents_0, 0), 0) AS nd, interest_coverage_0 AS cov FROM prof WHERE n >= 2),
  v1 AS (SELECT *, least(eg, 0.03) AS et, cap / nullif(pb, 0) AS book, ni - 0.1 * cap / nullif(pb, 0) AS ri,
    least(greatest(cap / (cap + nd) * 0.105 + nd / (cap + nd) * CASE WHEN cov > 0 THEN greatest(0.055, 0.045 + 10 / cov) ELSE 0.095 END * 0.75, 0.06), 0.20) AS wacc FROM v0),
  vals AS (SELECT symbol, cap AS market_cap, wacc, vol AS fcf_volatility,
    CASE WHEN oe > 0 THEN ({pv_sql('oe', 'eg', '0.15', 5)} + oe * power(1 + eg, 5) * (1 + et) / (0.15 - et) / power(1.15, 5)) * 0.75 ELSE 0 END AS owner_earnings,
    CASE WHEN fcf > 0 THEN {pv_sql('fcf', '0.05', '0.10', 5)} + fcf * power(1.05, 5) * 1.02 / 0.08 / power(1.1, 5) ELSE 0 END AS simple_dcf,
    CASE WHEN ev <> 0 AND mult <> 0 THEN greatest(med * ev / mult - (ev - cap), 0) ELSE 0 END AS ev_ebitda,
    CASE WHEN cap <> 0 AND ni <> 0 AND pb > 0 AND ri > 0 THEN (book + {pv_sql('ri', 'bg', '0.10', 5)} + ri * power(1 + bg, 6) / 0.07 / power(1.1, 5)) * 0.8 ELSE 0 END AS residual_income,
    {', '.join(f'{edcf_sql(w, g)} AS dcf_{n}' for n, g, w, _ in valuation.SCENARIOS)} FROM v1),
  vd AS (SELECT *, dcf_bear * 0.2 + dcf_base * 0.6 + dcf_bull * 0.2 AS dcf FROM vals)"""

for _name, _cols in (("v01_owner_earnings", "owner_earnings"), ("v02_simple_dcf", "simple_dcf"), ("v03_ev_ebitda", "ev_ebitda"), ("v04_residual_income", "residual_income"),
                     ("v06_enhanced_dcf", "dcf_base"), ("v07_dcf_scenarios", "dcf_bear dcf_base dcf_bull dcf")):
    @query(_name, f"{VALS} SELECT symbol, {rcols(_cols, 2)} FROM vd")
    def _(spark, sf, cols=_cols.split()):
        return tidy(valuation.valuations(pan(spark, sf), AS_OF).select("symbol", *cols), 2)


@query("v05_wacc", f"{VALS} SELECT symbol, {rcols('wacc fcf_volatility')} FROM vd")
def _(spark, sf):
    return tidy(valuation.valuations(pan(spark, sf), AS_OF).select("symbol", "wacc", "fcf_volatility"))


_gap = " + ".join(f"CASE WHEN {m} > 0 THEN {w} * ({m} - market_cap) / market_cap ELSE 0 END" for m, w in valuation.METHODS.items())
_wt = " + ".join(f"CASE WHEN {m} > 0 THEN {w} ELSE 0 END" for m, w in valuation.METHODS.items())


@query("v08_screen_valuation", f"""{VALS}, g AS (SELECT *, ({_gap}) / ({_wt}) AS weighted_gap FROM vd WHERE market_cap <> 0 AND {_wt} > 0)
  SELECT symbol, {r('weighted_gap', 5)} AS weighted_gap, CASE WHEN weighted_gap > 0.15 THEN 'bullish' WHEN weighted_gap < -0.15 THEN 'bearish' ELSE 'neutral' END AS signal,
  round_even(least(abs(weighted_gap) / 0.30 * 100, 100), 0) AS confidence FROM g""")
def _(spark, sf):
    return tidy(valuation.screen_valuation(pan(spark, sf), AS_OF).select("symbol", "weighted_gap", "signal", "confidence"), 5)


# -- screens ----------------------------------------------------------------------------

def case(x, cuts, default=0, op=">"):
    return "CASE " + " ".join(f"WHEN {x} {op} {c} THEN {p}" for c, p in cuts) + f" ELSE {default} END"


def fl(cond, pts=1):
    return f"CASE WHEN {cond} THEN {pts} ELSE 0 END"


def tri_sql(*conds):
    s = " + ".join(fl(c) for c in conds)
    return f"CASE WHEN {s} >= 2 THEN 'bullish' WHEN {s} = 0 THEN 'bearish' ELSE 'neutral' END"


def screen_sql(pre, parts, weights=None, top=10, high=None, low=None, source="prof"):
    high, low = (0.7 * top, 0.3 * top) if high is None else (high, low)
    weights = weights or [1] * len(parts)
    total = " + ".join(f"{p} * {w}" for p, w in zip(parts, weights))
    sub = ", ".join(f"CAST({e} AS DOUBLE) AS {p}" for p, e in parts.items())
    cols = ", ".join(f"{r(p, 4)} AS {p}" for p in parts)
    return f"""{pre}, sc AS (SELECT symbol, {sub} FROM {source}), tt AS (SELECT *, {total} AS score FROM sc)
      SELECT symbol, {cols}, {r('score', 4)} AS score, CAST({top} AS DOUBLE) AS max_score, CASE WHEN score >= {high} - 1e-12 THEN 'bullish' WHEN score <= {low} + 1e-12 THEN 'bearish' ELSE 'neutral' END AS signal FROM tt"""


K1 = f"""{PROF[1]}, v AS (SELECT symbol, {tri_sql('return_on_equity_0 > 0.15', 'net_margin_0 > 0.20', 'operating_margin_0 > 0.15')} AS profitability,
    {tri_sql('revenue_growth_0 > 0.10', 'earnings_growth_0 > 0.10', 'book_value_growth_0 > 0.10')} AS growth,
    {tri_sql('current_ratio_0 > 1.5', 'debt_to_equity_0 <> 0 AND debt_to_equity_0 < 0.5', 'free_cash_flow_per_share_0 <> 0 AND earnings_per_share_0 <> 0 AND free_cash_flow_per_share_0 > earnings_per_share_0 * 0.8')} AS health,
    CASE {fl('price_to_earnings_ratio_0 > 25')} + {fl('price_to_book_ratio_0 > 3')} + {fl('price_to_sales_ratio_0 > 5')} WHEN 0 THEN 'bullish' WHEN 1 THEN 'neutral' ELSE 'bearish' END AS price_ratios FROM prof),
  k AS (SELECT *, len(list_filter([profitability, growth, health, price_ratios], lambda x: x = 'bullish')) AS bu, len(list_filter([profitability, growth, health, price_ratios], lambda x: x = 'bearish')) AS be FROM v)"""


@query("k01_fundamentals", f"""{K1} SELECT symbol, profitability, growth, health, price_ratios, CASE WHEN bu > be THEN 'bullish' WHEN be > bu THEN 'bearish' ELSE 'neutral' END AS signal,
  greatest(bu, be) / 4 * 100.0::DOUBLE AS confidence FROM k""")
def _(spark, sf):
    return tidy(screens.screen_fundamentals(pan(spark, sf), AS_OF))


@query("k02_growth", f"""{PROF[12]}, {INSIDER_AT}, f AS (SELECT symbol, coalesce((buy_value - sell_value) / nullif(buy_value + sell_value, 0), 0) AS nf FROM flow),
  s AS (SELECT symbol, least({case('revenue_growth_0', [(0.2, 0.4), (0.1, 0.2)])} + {fl('revenue_growth_0 IS NOT NULL AND ' + L['slope']('revenue_growth') + ' > 0', 0.1)}
      + {case('earnings_per_share_growth_0', [(0.2, 0.25), (0.1, 0.1)])} + {fl('earnings_per_share_growth_0 IS NOT NULL AND ' + L['slope']('earnings_per_share_growth') + ' > 0', 0.05)} + {fl('free_cash_flow_growth_0 > 0.15', 0.1)}, 1) AS growth,
    least({case('peg_ratio_0', [(1, 0.5), (2, 0.25)], op='<')} + {case('price_to_sales_ratio_0', [(2, 0.5), (5, 0.25)], op='<')}, 1) AS valuation,
    least({fl('gross_margin_0 > 0.5', 0.2)} + {fl(L['slope']('gross_margin') + ' > 0', 0.2)} + {fl('operating_margin_0 > 0.15', 0.2)} + {fl(L['slope']('operating_margin') + ' > 0', 0.2)} + {fl(L['slope']('net_margin') + ' > 0', 0.2)}, 1) AS margins,
    {case('coalesce(nf, 0)', [(0.5, 1.0), (0.1, 0.7), (-0.1, 0.5)], 0.2)} AS insider,
    greatest(1 - {case('debt_to_equity_0', [(1.5, 0.5), (0.8, 0.2)])} - {case('current_ratio_0', [(1, 0.5), (1.5, 0.2)], op='<')}, 0) AS health FROM prof LEFT JOIN f USING (symbol) WHERE n >= 4),
  t AS (SELECT *, growth * 0.4 + valuation * 0.25 + margins * 0.15 + insider * 0.1 + health * 0.1 AS score FROM s)
  SELECT symbol, {rcols('growth valuation margins insider health score', 4)}, CASE WHEN score > 0.6 THEN 'bullish' WHEN score < 0.4 THEN 'bearish' ELSE 'neutral' END AS signal FROM t""")
def _(spark, sf):
    return tidy(screens.screen_growth(pan(spark, sf), frames.insider(spark, sf), AS_OF).drop("max_score", "confidence"), 4)


@query("k03_sentiment", f"""WITH {INSIDER_AT}, {BRAND_NEWS_AT}, i AS (SELECT symbol, count(*) FILTER (transaction_shares >= 0) AS ib, count(*) FILTER (transaction_shares < 0) AS isell, count(transaction_shares) AS inn FROM insider GROUP BY 1),
  n AS (SELECT symbol, count(*) FILTER (sentiment = 'positive') AS nb, count(*) FILTER (sentiment = 'negative') AS ns, count(sentiment) AS nn FROM brand_news GROUP BY 1),
  j AS (SELECT symbol, coalesce(ib, 0) * 0.3 + coalesce(nb, 0) * 0.7 AS bu, coalesce(isell, 0) * 0.3 + coalesce(ns, 0) * 0.7 AS be, coalesce(inn, 0) * 0.3 + coalesce(nn, 0) * 0.7 AS tot FROM i FULL JOIN n USING (symbol))
  SELECT symbol, {r('bu', 4)} AS bullish_weight, {r('be', 4)} AS bearish_weight, CASE WHEN bu > be THEN 'bullish' WHEN be > bu THEN 'bearish' ELSE 'neutral' END AS signal, {r('greatest(bu, be) / nullif(tot, 0) * 100', 4)} AS confidence FROM j""")
def _(spark, sf):
    return tidy(screens.screen_sentiment(frames.insider(spark, sf), frames.brand_news(spark, sf), AS_OF), 4)


def _trim(x, n=63):
    return roll(x, "ret", n)


TECH = f"""{ADX}, {ema_sql('nb', 'close', 8, 'e8')}, {ema_sql('nb', 'close', 21, 'e21')}, {ema_sql('nb', 'close', 55, 'e55')},
  rets AS (SELECT *, close / lag(close) OVER ({W_}) - 1 AS ret FROM nb),
  ind AS (SELECT symbol, rn, (close - {roll('avg', 'close', 50)}) / ({roll('stddev_samp', 'close', 50)}) AS z, {roll('avg', 'close', 20)} AS m20, {roll('stddev_samp', 'close', 20)} AS s20, close,
    0.4 * ({roll('sum', 'ret', 21)}) + 0.3 * ({roll('sum', 'ret', 63)}) + 0.3 * ({roll('sum', 'ret', 126)}) AS mom, volume / ({roll('avg', 'volume', 21)}) AS vm,
    ({roll('stddev_samp', 'ret', 21)}) * sqrt(252) AS hv, {_trim('skewness')} AS skew, ts FROM rets),
  ind2 AS (SELECT *, hv / ({roll('avg', 'hv', 63)}) AS vr, (hv - ({roll('avg', 'hv', 63)})) / ({roll('stddev_samp', 'hv', 63)}) AS vz, (close - (m20 - 2 * s20)) / (4 * s20) AS pb FROM ind),
  tau AS ({_lags}), hu AS (SELECT symbol, regr_slope(ln(greatest(sqrt(s), 1e-8)), ln(k)) AS h FROM tau GROUP BY 1),
  lr AS (SELECT i.*, e8.v AS a8, e21.v AS a21, e55.v AS a55, ed.num / nullif(ed.den, 0) AS adx, h FROM ind2 i JOIN (SELECT symbol, max(rn) AS rn FROM nb GROUP BY 1) USING (symbol, rn)
    JOIN e8 USING (symbol, rn) JOIN e21 USING (symbol, rn) JOIN e55 USING (symbol, rn) JOIN ed USING (symbol, rn) JOIN hu USING (symbol)),
  sg AS (SELECT symbol, 'trend' AS strategy, CASE WHEN a8 > a21 AND a21 > a55 THEN 'bullish' WHEN a8 <= a21 AND a21 <= a55 THEN 'bearish' ELSE 'neutral' END AS signal, adx / 100 AS c FROM lr
    UNION ALL SELECT symbol, 'mean_reversion', CASE WHEN z < -2 AND pb < 0.2 THEN 'bullish' WHEN z > 2 AND pb > 0.8 THEN 'bearish' ELSE 'neutral' END, least(abs(z) / 4, 1) FROM lr
    UNION ALL SELECT symbol, 'momentum', CASE WHEN mom > 0.05 AND vm > 1 THEN 'bullish' WHEN mom < -0.05 AND vm > 1 THEN 'bearish' ELSE 'neutral' END, least(abs(mom) * 5, 1) FROM lr
    UNION ALL SELECT symbol, 'volatility', CASE WHEN vr < 0.8 AND vz < -1 THEN 'bullish' WHEN vr > 1.2 AND vz > 1 THEN 'bearish' ELSE 'neutral' END, least(abs(vz) / 3, 1) FROM lr
    UNION ALL SELECT symbol, 'stat_arb', CASE WHEN h < 0.4 AND skew > 1 THEN 'bullish' WHEN h < 0.4 AND skew < -1 THEN 'bearish' ELSE 'neutral' END, (0.5 - h) * 2 FROM lr),
  sig AS (SELECT symbol, strategy, signal, CASE WHEN signal = 'neutral' THEN 0.5 ELSE c END AS confidence FROM sg)"""
WEIGHTS = "CASE strategy " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in screens.TECH_WEIGHTS.items()) + " END"
VOTE = f"""SELECT symbol, sum(CASE signal WHEN 'bullish' THEN 1 WHEN 'bearish' THEN -1 ELSE 0 END * {WEIGHTS} * confidence) / sum({WEIGHTS} * confidence) AS s FROM sig GROUP BY 1"""


@query("k04_technical", f"""WITH RECURSIVE {TECH}, v AS ({VOTE}) SELECT symbol, CASE WHEN s > 0.2 THEN 'bullish' WHEN s < -0.2 THEN 'bearish' ELSE 'neutral' END AS signal, {r('abs(s)', 5)} AS confidence FROM v""")
def _(spark, sf):
    return tidy(screens.screen_technical(frames.bars(spark, sf)), 5)


@query("k04_technical_parts", f"WITH RECURSIVE {TECH} SELECT symbol, strategy, signal, {r('confidence', 5)} AS confidence FROM sig")
def _(spark, sf):
    return tidy(screens.technical_signals(frames.bars(spark, sf)), 5)


_aw = "CASE right(analyst, 1) WHEN '0' THEN 0.5 WHEN '1' THEN 1.0 WHEN '2' THEN 2.0 END"


@query("k05_combine_signals", f"""WITH {SIGNALS}, v AS (SELECT date, symbol, coalesce(sum(CASE signal WHEN 'bullish' THEN 1 WHEN 'bearish' THEN -1 ELSE 0 END * {_aw} * confidence) / sum({_aw} * confidence), 0) AS s FROM signals GROUP BY 1, 2)
  SELECT date, symbol, CASE WHEN s > 0.2 THEN 'bullish' WHEN s < -0.2 THEN 'bearish' ELSE 'neutral' END AS signal, {r('abs(s)', 5)} AS confidence FROM v""")
def _(spark, sf):
    return tidy(screens.combine_signals(frames.signals(spark, sf), {"analyst0": 0.5, "analyst1": 1.0, "analyst2": 2.0}, ("date", "symbol"), "analyst"), 5)


@query("p11_compact_signals", f"WITH {SIGNALS} SELECT event_id, analyst, symbol, signal, confidence FROM signals WHERE confidence IS NOT NULL")
def _(spark, sf):
    return screens.compact_signals(frames.signals(spark, sf)).select("event_id", "analyst", "symbol", "signal", "confidence")


_eps, _div, _rev, _fcf, _om2 = "earnings_per_share", "dividends_and_other_cash_distributions", "revenue", "free_cash_flow", "operating_margin"
K6 = {
    "earnings": f"""CASE WHEN coalesce(len({_eps}), 0) < 2 THEN 0 ELSE CASE WHEN len(list_filter({_eps}, lambda v: v > 0)) = len({_eps}) THEN 3 WHEN len(list_filter({_eps}, lambda v: v > 0)) >= len({_eps}) * 0.8 THEN 2 ELSE 0 END
        + {fl(f'{_eps}[1] > {_eps}[-1]')} END""",
    "strength": f"{case('current_assets_0 / current_liabilities_0', [(2.0, 2), (1.5, 1)], op='>=')} + {case('total_liabilities_0 / total_assets_0', [(0.5, 2), (0.8, 1)], op='<')} + {fl(L['major'](_div, 'v < 0'))}",
    "valuation": f"""CASE WHEN current_assets_0 - total_liabilities_0 > 0 THEN CASE WHEN current_assets_0 - total_liabilities_0 > market_cap_0 THEN 4 WHEN current_assets_0 - total_liabilities_0 >= market_cap_0 * 0.67 THEN 2 ELSE 0 END ELSE 0 END
        + {case("CASE WHEN earnings_per_share_0 > 0 AND book_value_per_share_0 > 0 THEN (sqrt(22.5 * earnings_per_share_0 * book_value_per_share_0) - market_cap_0 / outstanding_shares_0) / (market_cap_0 / outstanding_shares_0) END", [(0.5, 3), (0.2, 1)])}""",
}


@query("k06_graham", screen_sql(PROF[10], K6, top=15))
def _(spark, sf):
    return tidy(screens.screen_graham(pan(spark, sf), AS_OF), 4)


def mos(g, rate, mult):
    iv = f"({pv_sql('free_cash_flow_0', g, rate, 5)} + free_cash_flow_0 * power(1 + {g}, 5) * {mult} / power(1 + {rate}, 5))"
    return f"CASE WHEN free_cash_flow_0 > 0 THEN ({iv} - market_cap_0) / market_cap_0 END"


K9 = {
    "quality": f"""CASE WHEN len(revenue) >= 2 AND revenue[1] > revenue[-1] THEN CASE WHEN {L['growth'](_rev)} > 0.5 THEN 2 ELSE 1 END ELSE 0 END + {fl(L['major'](_om2, 'v > 0.15'), 2)}
        + {fl(L['major'](_fcf, 'v > 0'))} + {fl('return_on_equity_0 > 0.15', 2)}""",
    "discipline": f"""CASE WHEN len(debt_to_equity) > 0 THEN {fl(L['major']('debt_to_equity', 'v < 1.0'), 2)} ELSE CASE WHEN len(list_filter(range(1, len(total_assets) + 1), lambda i: total_liabilities[i] / total_assets[i] < 0.5)) >= len(total_assets) // 2 + 1 THEN 2 ELSE 0 END END
        + {fl(L['major'](_div, 'v < 0'))} + {fl('len(outstanding_shares) >= 2 AND outstanding_shares[1] < outstanding_shares[-1]')}""",
    "activism": fl(f"{L['growth'](_rev)} > 0.15 AND list_avg(operating_margin) < 0.10", 2),
    "valuation": case(mos('0.06', '0.10', 15), [(0.3, 3), (0.1, 1)]),
}


@query("k09_ackman", screen_sql(PROF[5], K9, top=20))
def _(spark, sf):
    return tidy(screens.screen_ackman(pan(spark, sf), AS_OF), 4)


_rd, _cx = "research_and_development", "capital_expenditure"
_rdz = f"list_filter({_rd}, lambda v: v <> 0)"
K10 = {
    "disruptive": f"""(CASE WHEN len(revenue) >= 3 THEN {fl(f"len({L['gs'](_rev)}) >= 2 AND ({L['gs'](_rev)})[1] > ({L['gs'](_rev)})[-1]", 2)} + {case(f"({L['gs'](_rev)})[1]", [(1.0, 3), (0.5, 2), (0.2, 1)])} ELSE 0 END
        + CASE WHEN len(gross_margin) >= 2 THEN {case('gross_margin[1] - gross_margin[-1]', [(0.05, 2), (0, 1)])} + {fl('gross_margin[1] > 0.5', 2)} ELSE 0 END
        + {fl(f"{L['growth'](_rev)} > {L['growth']('operating_expense')}", 2)} + {case(f'{_rd}[1] / revenue[1]', [(0.15, 3), (0.08, 2), (0.05, 1)])}) / 12 * 5""",
    "innovation": f"""(CASE WHEN len({_rdz}) >= 2 THEN {case(L['growth'](_rdz), [(0.5, 3), (0.2, 2)])} + {fl(f'{_rdz}[1] / revenue[1] > {_rdz}[-1] / revenue[-1]', 2)} ELSE 0 END
        + CASE WHEN len({_fcf}) >= 2 THEN CASE WHEN {L['growth'](_fcf)} > 0.3 AND len(list_filter({_fcf}, lambda v: v > 0)) = len({_fcf}) THEN 3 WHEN len(list_filter({_fcf}, lambda v: v > 0)) >= len({_fcf}) * 0.75 THEN 2
            WHEN len(list_filter({_fcf}, lambda v: v > 0)) > len({_fcf}) * 0.5 THEN 1 ELSE 0 END ELSE 0 END
        + CASE WHEN len({_om2}) >= 2 THEN CASE WHEN {_om2}[1] > 0.15 AND {_om2}[1] - {_om2}[-1] > 0 THEN 3 WHEN {_om2}[1] > 0.10 THEN 2 WHEN {_om2}[1] - {_om2}[-1] > 0 THEN 1 ELSE 0 END ELSE 0 END
        + CASE WHEN {_cx}[1] / revenue[1] > 0.10 AND ({_cx}[1] - {_cx}[-1]) / {_cx}[-1] > 0.2 THEN 2 WHEN {_cx}[1] / revenue[1] > 0.05 THEN 1 ELSE 0 END
        + CASE WHEN len({_div}) > 0 THEN {case(f'{_div}[1] / {_fcf}[1]', [(0.2, 2), (0.4, 1)], op='<')} ELSE 0 END) / 15 * 5""",
    "valuation": case(mos('0.20', '0.15', 25), [(0.5, 3), (0.2, 1)]),
}


@query("k10_wood", screen_sql(PROF[5], K10, top=15))
def _(spark, sf):
    return tidy(screens.screen_wood(pan(spark, sf), AS_OF), 4)


K11 = {
    "value": f"{case('free_cash_flow_0 / market_cap_0', [(0.15, 4), (0.12, 3), (0.08, 2)], op='>=')} + {case('ev_to_ebit_0', [(6, 2), (10, 1)], op='<')}",
    "balance_sheet": f"{case('debt_to_equity_0', [(0.5, 2), (1, 1)], op='<')} + {fl('cash_and_equivalents_0 > total_debt_0')}",
    "insider": "CASE WHEN bought - sold > 0 THEN CASE WHEN (bought - sold) / greatest(sold, 1) > 1 THEN 2 ELSE 1 END ELSE 0 END",
    "contrarian": fl("neg >= 5"),
}
NEG = "ng AS (SELECT symbol, count(*) FILTER (sentiment = 'negative') AS neg FROM brand_news GROUP BY 1)"


@query("k11_burry", screen_sql(f"{PROF[5]}, {INSIDER_YEAR}, {BRAND_NEWS_YEAR}, {NEG}", K11, top=12, source="prof LEFT JOIN flow USING (symbol) LEFT JOIN ng USING (symbol)"))
def _(spark, sf):
    return tidy(screens.screen_burry(pan(spark, sf), frames.insider(spark, sf), frames.brand_news(spark, sf), AS_OF), 4)


WORDS = ["anat", "mento"]
MOOD = f"""md AS (SELECT symbol, CASE WHEN count(*) FILTER (contains(lower(title), 'anat') OR contains(lower(title), 'mento')) > count(*) * 0.3 THEN 3
    WHEN count(*) FILTER (contains(lower(title), 'anat') OR contains(lower(title), 'mento')) > 0 THEN 6 ELSE 8 END AS mood FROM brand_news GROUP BY 1)"""
INS = f"CASE WHEN buys + sells > 0 THEN {case('buys / (buys + sells)', [(0.7, 8), (0.4, 6)], 4)} ELSE 5 END"
MOODY = "prof LEFT JOIN md USING (symbol) LEFT JOIN flow USING (symbol)"
_g3 = [(0.25, 3), (0.10, 2), (0.02, 1)]
_pe = "CASE WHEN net_income[1] > 0 THEN market_cap_0 / net_income[1] END"
_eg = f"CASE WHEN len({_eps}) >= 2 AND {_eps}[-1] > 0 THEN CASE WHEN {_eps}[1] > 0 THEN {L['cagr'](_eps)} ELSE ({_eps}[1] - {_eps}[-1]) / ({_eps}[-1] * (len({_eps}) - 1)) END END"
_peg = f"CASE WHEN {_eg} > 0 THEN {_pe} / ({_eg} * 100) END"
K12 = {
    "growth": f"least(10, ({case(L['growth'](_rev), _g3)} + CASE WHEN abs({_eps}[-1]) > 1e-9 THEN {case(L['growth'](_eps), _g3)} ELSE 0 END) / 6 * 10)",
    "valuation": f"least(10, ({case(_pe, [(15, 2), (25, 1)], op='<')} + {case(_peg, [(1, 3), (2, 2), (3, 1)], op='<')}) / 5 * 10)",
    "fundamentals": f"""least(10, ({case('CASE WHEN len(total_debt) = len(shareholders_equity) THEN total_debt[1] / shareholders_equity[1] END', [(0.5, 2), (1, 1)], op='<')}
        + {case(f'{_om2}[1]', [(0.2, 2), (0.1, 1)])} + {fl(f'{_fcf}[1] > 0', 2)}) / 6 * 10)""",
    "sentiment": "coalesce(mood, 5)", "insider": INS,
}


@query("k12_lynch", screen_sql(f"{PROF[5]}, {INSIDER_AT}, {BRAND_NEWS_AT}, {MOOD}", K12, [0.3, 0.25, 0.2, 0.15, 0.1], 10, 7.5, 4.5, MOODY))
def _(spark, sf):
    return tidy(screens.screen_lynch(pan(spark, sf), frames.insider(spark, sf), frames.brand_news(spark, sf), AS_OF, WORDS), 4)


_y = f"CASE WHEN len({_fcf}) >= 3 AND list_avg({_fcf}[1:5]) > 0 THEN list_avg({_fcf}[1:5]) / market_cap_0 END"
_r3 = f"list_avg({_fcf}[1:3])"
K15 = {
    "downside": f"""least(10, {fl('cash_and_equivalents_0 - total_debt_0 > 0', 3)} + {case('current_assets_0 / current_liabilities_0', [(2.0, 2), (1.2, 1)], op='>=')}
        + {case('CASE WHEN shareholders_equity_0 > 0 THEN total_debt_0 / shareholders_equity_0 END', [(0.3, 2), (0.7, 1)], op='<')}
        + CASE WHEN {_r3} > 0 AND {_r3} >= {L['old'](_fcf)} THEN 2 WHEN {_r3} > 0 THEN 1 ELSE 0 END)""",
    "valuation": f"""CASE WHEN {_y} IS NOT NULL THEN {case(_y, [(0.10, 4), (0.07, 3), (0.05, 2), (0.03, 1)])}
        + {case("list_avg(list_transform(range(1, len(revenue) + 1), lambda i: capital_expenditure[i] / revenue[i]))", [(0.05, 2), (0.10, 1)], op='<')} ELSE 0 END""",
    "double_potential": f"""least(10, {case(f"list_avg(revenue[1:3]) / ({L['old'](_rev)}) - 1", [(0.15, 2), (0.05, 1)])} + {case(f"{_r3} / nullif({L['old'](_fcf)}, 0) - 1", [(0.20, 3), (0.08, 2), (0, 1)])}
        + {case(_y, [(0.08, 3), (0.05, 1)])})""",
}


@query("k15_pabrai", screen_sql(PROF[8], K15, [0.45, 0.35, 0.20], 10, 7.5, 4.0))
def _(spark, sf):
    return tidy(screens.screen_pabrai(pan(spark, sf), AS_OF), 4)
