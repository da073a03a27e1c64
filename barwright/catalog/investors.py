"""Registered investor screens, second part."""

from pyspark.sql import functions as F

from barwright.catalog.fundamentals import (
    AS_OF, INS, L, MOOD, MOODY, PROF, WORDS, case, fl, pan, pv_sql, screen_sql)
from barwright.catalog.registry import query, r, rcols, tidy
from barwright.catalog.sqlframes import BRAND_BARS, BRAND_NEWS_AT, INSIDER_AT
from barwright.plans import screens
from barwright.sources import frames

_om, _fcf, _eps, _rev, _rd = "operating_margin", "free_cash_flow", "earnings_per_share", "revenue", "research_and_development"
_de = "CASE WHEN len(total_debt) = len(shareholders_equity) THEN total_debt[1] / shareholders_equity[1] END"
_fc = [(0.20, 3), (0.10, 2), (0.03, 1)]
_rdr = f"CASE WHEN len({_rd}) = len(revenue) THEN {_rd}[1] / revenue[1] END"
K13 = {
    "growth": f"""least(10, ({case(L['cagr'](_rev), _fc)} + {case(L['cagr'](_eps), _fc)} + CASE WHEN {_rdr} BETWEEN 0.03 AND 0.15 THEN 3 WHEN {_rdr} > 0.15 THEN 2 WHEN {_rdr} > 0 THEN 1 ELSE 0 END) / 9 * 10)""",
    "margins": f"""least(10, (CASE WHEN {_om}[1] >= {_om}[-1] AND {_om}[-1] > 0 THEN 2 WHEN {_om}[1] > 0 THEN 1 ELSE 0 END + {case('gross_margin[1]', [(0.5, 2), (0.3, 1)])}
        + {case(f'list_stddev_pop({_om})', [(0.02, 2), (0.05, 1)], op='<')}) / 6 * 10)""",
    "management": f"""least(10, ({case('CASE WHEN net_income[1] > 0 THEN net_income[1] / shareholders_equity[1] END', [(0.2, 3), (0.1, 2), (0, 1)])} + {case(_de, [(0.3, 2), (1.0, 1)], op='<')}
        + {fl(f'len(list_filter({_fcf}, lambda v: v > 0)) / len({_fcf}) > 0.8')}) / 6 * 10)""",
    "valuation": f"""least(10, ({case('CASE WHEN net_income[1] > 0 THEN market_cap_0 / net_income[1] END', [(20, 2), (30, 1)], op='<')} + {case(f'CASE WHEN {_fcf}[1] > 0 THEN market_cap_0 / {_fcf}[1] END', [(20, 2), (30, 1)], op='<')}) / 4 * 10)""",
    "insider": INS, "sentiment": "coalesce(mood, 5)",
}


@query("k13_fisher", screen_sql(f"{PROF[5]}, {INSIDER_AT}, {BRAND_NEWS_AT}, {MOOD}", K13, [0.3, 0.25, 0.2, 0.15, 0.05, 0.05], 10, 7.5, 4.5, MOODY))
def _(spark, sf):
    return tidy(screens.screen_fisher(pan(spark, sf), frames.insider(spark, sf), frames.brand_news(spark, sf), AS_OF, WORDS), 4)


PX = f"""{BRAND_BARS}, px AS (SELECT symbol, count(*) AS k, arg_min(close, ts) AS c0, arg_max(close, ts) AS c1, stddev_pop(ret) AS sd
    FROM (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM brand_bars WHERE ts <= DATE '{AS_OF}') GROUP BY 1)"""
_dc = [(0.08, 3), (0.04, 2), (0.01, 1)]
_ev = "(market_cap_0 + coalesce(total_debt[1], 0) - coalesce(cash_and_equivalents[1], 0))"


def mult(top, x, cuts):
    return case(f"CASE WHEN {top} > 0 AND {x}[1] > 0 THEN {top} / {x}[1] END", cuts, op="<")


K14 = {
    "growth_momentum": f"least(10, ({case(L['cagr'](_rev), _dc)} + {case(L['cagr'](_eps), _dc)} + {case('CASE WHEN k > 30 AND c0 > 0 THEN (c1 - c0) / c0 END', [(0.5, 3), (0.2, 2), (0, 1)])}) / 9 * 10)",
    "risk_reward": f"least(10, ({case(_de, [(0.3, 3), (0.7, 2), (1.5, 1)], op='<')} + {case('sd', [(0.01, 3), (0.02, 2), (0.04, 1)], op='<')}) / 6 * 10)",
    "valuation": f"least(10, ({mult('market_cap_0', 'net_income', [(15, 2), (25, 1)])} + {mult('market_cap_0', _fcf, [(15, 2), (25, 1)])} + {mult(_ev, 'ebit', [(15, 2), (25, 1)])} + {mult(_ev, 'ebitda', [(10, 2), (18, 1)])}) / 8 * 10)",
    "sentiment": "coalesce(mood, 5)", "insider": INS,
}


@query("k14_druckenmiller", screen_sql(f"{PROF[5]}, {INSIDER_AT}, {BRAND_NEWS_AT}, {MOOD}, {PX}", K14, [0.35, 0.2, 0.2, 0.15, 0.1], 10, 7.5, 4.5, MOODY + " LEFT JOIN px USING (symbol)"))
def _(spark, sf):
    return tidy(screens.screen_druckenmiller(pan(spark, sf), frames.brand_bars(spark, sf), frames.insider(spark, sf), frames.brand_news(spark, sf), AS_OF, WORDS), 4)


_pe = "price_to_earnings_ratio"
_umed = f"list_sort({_pe})[len({_pe}) // 2 + 1]"
_fade = " + ".join(f"f * (1 + g + {y - 1} * (0.025 - g) / 9) / power(1 + rr, {y})" for y in range(1, 11))


@query("k16_damodaran", f"""{PROF[5]}, d AS (SELECT symbol, {case(L['cagr'](_rev), [(0.08, 2), (0.03, 1)])} + {fl(f'{_fcf}[1] > {_fcf}[-1]')} + {fl('return_on_invested_capital_0 > 0.10')} AS growth,
    {fl('beta_0 < 1.3')} + {fl('debt_to_equity_0 < 1')} + {fl('ebit_0 / nullif(abs(interest_expense_0), 0) > 3')} AS risk,
    CASE WHEN len({_pe}) >= 5 THEN CASE WHEN {_pe}[1] < 0.7 * {_umed} THEN 1 WHEN {_pe}[1] > 1.3 * {_umed} THEN -1 ELSE 0 END ELSE 0 END AS rel,
    least({L['cagr'](_rev)}, 0.12) AS g, 0.04 + beta_0 * 0.05 AS rr, free_cash_flow_0 AS f, market_cap_0 AS cap FROM prof),
  m AS (SELECT *, ({_fade} + f * 1.025 / (rr - 0.025) / power(1 + rr, 10) - cap) / cap AS mos FROM d)
  SELECT symbol, growth::DOUBLE AS growth, risk::DOUBLE AS risk, rel::DOUBLE AS relative_valuation, (growth + risk + rel)::DOUBLE AS score, 8.0::DOUBLE AS max_score, {r('mos', 4)} AS margin_of_safety,
    CASE WHEN mos >= 0.25 THEN 'bullish' WHEN mos <= -0.25 THEN 'bearish' ELSE 'neutral' END AS signal FROM m""")
def _(spark, sf):
    return tidy(screens.screen_damodaran(pan(spark, sf), AS_OF), 4)


def pos(a):
    return f"list_filter({a}, lambda v: v > 0)"


def rate3(a):
    return f"CASE WHEN len({pos(a)}) >= 3 THEN (power(({pos(a)})[1] / ({pos(a)})[-1], 1.0 / (len({pos(a)}) - 1)) - 1) * 100 END"


def steady(a):
    return f"(1 - len(list_filter(range(1, len({a})), lambda i: ({a})[i] < ({a})[i + 1])) / nullif(len({a}) - 1, 0))"


_j = [(20, 3), (15, 2), (10, 1)]
_eq, _n4 = "(total_assets_0 - total_liabilities_0)", "list_filter(net_income[1:4], lambda v: v > 0)"


@query("k17_jhunjhunwala", f"""{PROF[5]}, j AS (SELECT symbol, {case(f'CASE WHEN net_income_0 > 0 AND {_eq} > 0 THEN net_income_0 / {_eq} * 100 END', _j)} + {case('operating_income_0 / revenue_0 * 100', [(20, 2), (15, 1)])} + {case(rate3(_eps), _j)} AS profitability,
    CASE WHEN n >= 3 THEN {case(rate3('revenue'), _j)} + {case(rate3('net_income'), [(25, 3), (20, 2), (15, 1)])} + {fl(steady('revenue') + ' >= 0.8')} ELSE 0 END AS growth,
    {case('total_liabilities_0 / total_assets_0', [(0.5, 2), (0.7, 1)], op='<')} + {case('current_assets_0 / current_liabilities_0', [(2.0, 2), (1.5, 1)])} AS balance_sheet,
    {fl('free_cash_flow_0 > 0', 2)} + {fl('dividends_and_other_cash_distributions_0 < 0')} AS cash_flow,
    CASE WHEN issuance_or_purchase_of_equity_shares_0 < 0 THEN 2 WHEN issuance_or_purchase_of_equity_shares_0 = 0 THEN 1 ELSE 0 END AS management,
    (CASE WHEN {_eq} > 0 THEN {case(f'net_income_0 / {_eq}', [(0.20, 1.0), (0.15, 0.8), (0.10, 0.6)], 0.3)} ELSE 0 END + {case('total_liabilities_0 / total_assets_0', [(0.3, 1.0), (0.5, 0.7), (0.7, 0.4)], 0.1, '<')}
      + CASE WHEN len({_n4}) >= 3 THEN {steady(_n4)} ELSE 0.5 END) / 3 AS q, net_income_0 AS ni, market_cap_0 AS cap, len({pos('net_income')}) AS k, {L['cagr'](pos('net_income'))} AS h FROM prof),
  t AS (SELECT *, CASE WHEN h > 0.25 THEN 0.20 WHEN h > 0.15 THEN h * 0.8 WHEN h > 0.05 THEN h * 0.9 ELSE 0.05 END AS g, CASE WHEN q >= 0.8 THEN 0.12 WHEN q >= 0.6 THEN 0.15 ELSE 0.18 END AS rr,
    CASE WHEN q >= 0.8 THEN 18 WHEN q >= 0.6 THEN 15 ELSE 12 END AS m, profitability + growth + balance_sheet + cash_flow + management AS score FROM j),
  v AS (SELECT *, CASE WHEN ni > 0 THEN CASE WHEN k < 2 THEN ni * 12 ELSE {pv_sql('ni', 'g', 'rr', 5)} + ni * power(1 + g, 5) * m / power(1 + rr, 5) END END AS iv FROM t), w AS (SELECT *, (iv - cap) / cap AS mos FROM v)
  SELECT symbol, {', '.join(f'{c}::DOUBLE AS {c}' for c in ('profitability', 'growth', 'balance_sheet', 'cash_flow', 'management', 'score'))}, 24.0::DOUBLE AS max_score, {r('mos', 4)} AS margin_of_safety, {r('q', 4)} AS quality,
    CASE WHEN mos >= 0.3 THEN 'bullish' WHEN mos <= -0.3 THEN 'bearish' WHEN q >= 0.7 AND score >= 14.4 THEN 'bullish' WHEN q <= 0.4 OR score <= 7.2 THEN 'bearish' ELSE 'neutral' END AS signal FROM w""")
def _(spark, sf):
    return tidy(screens.screen_jhunjhunwala(pan(spark, sf), AS_OF), 4)


_gm, _ni, _oi = "gross_margin", "net_income", "operating_income"


def _stab(a):
    return f"CASE WHEN list_avg({a}) > 0 THEN 1 - list_stddev_pop({a}) / list_avg({a}) ELSE 0 END"


_bv = "list_transform(range(1, len(shareholders_equity) + 1), lambda i: shareholders_equity[i] / outstanding_shares[i])"
_cxr = "list_transform(range(1, least(len(revenue), 5) + 1), lambda i: abs(capital_expenditure[i]) / revenue[i])"
_ups = "len(list_filter(range(1, len(bv)), lambda i: bv[i] > bv[i + 1])) / (len(bv) - 1)"


@query("k07_buffett", f"""{PROF[10]}, b0 AS (SELECT *, {_bv} AS bv, {_cxr} AS cxr, list_filter({_ni}[1:5], lambda v: v <> 0) AS n5 FROM prof),
  b1 AS (SELECT symbol, {fl('return_on_equity_0 > 0.15', 2)} + {fl('debt_to_equity_0 <> 0 AND debt_to_equity_0 < 0.5', 2)} + {fl('operating_margin_0 > 0.15', 2)} + {fl('current_ratio_0 > 1.5')} AS fundamentals,
    {fl(f'n >= 4 AND len({_ni}) >= 4 AND len(list_filter(range(1, len({_ni})), lambda i: {_ni}[i] > {_ni}[i + 1])) = len({_ni}) - 1', 3)} AS consistency,
    CASE WHEN n >= 5 THEN least(5, {case('len(list_filter(return_on_equity, lambda v: v > 0.15)) / len(return_on_equity)', [(0.8, 2), (0.6, 1)], op='>=')} + {fl('list_avg(operating_margin) > 0.2 AND list_avg(operating_margin[1:3]) >= list_avg(operating_margin[-3:])')}
      + {fl('len(list_filter(asset_turnover, lambda v: v > 1)) > 0')} + {fl(f"({_stab('return_on_equity')} + {_stab('operating_margin')}) / 2 > 0.7")}) ELSE 0 END AS moat,
    CASE WHEN list_avg({_gm}[1:2]) > list_avg({_gm}[-2:]) + 0.02 THEN 3 WHEN list_avg({_gm}[1:2]) > list_avg({_gm}[-2:]) THEN 2 WHEN abs(list_avg({_gm}[1:2]) - list_avg({_gm}[-2:])) < 0.01 THEN 1 ELSE 0 END + {case(f'list_avg({_gm})', [(0.5, 2), (0.3, 1)])} AS pricing_power,
    {case(_ups, [(0.8, 3), (0.6, 2), (0.4, 1)], op='>=')} + CASE WHEN bv[-1] < 0 AND bv[1] > 0 THEN 3 ELSE {case(L['cagr']('bv'), [(0.15, 2), (0.1, 1)])} END AS book_value,
    {fl('issuance_or_purchase_of_equity_shares_0 < 0')} + {fl('dividends_and_other_cash_distributions_0 < 0')} AS management, market_cap_0 AS cap,
    net_income_0 + depreciation_and_amortization_0 - list_sort([abs(capital_expenditure_0) * 0.85, depreciation_and_amortization_0, list_avg(cxr) * revenue_0])[2]
      - ((current_assets[1] - current_liabilities[1]) - (current_assets[2] - current_liabilities[2])) AS oe,
    CASE WHEN len(n5) >= 3 AND n5[-1] > 0 THEN greatest(-0.05, least(CASE WHEN n5[1] > 0 THEN power(n5[1] / n5[-1], 1.0 / (len(n5) - 1)) - 1 ELSE -1 END, 0.15)) * 0.7 ELSE 0.03 END AS g FROM b0),
  b2 AS (SELECT *, least(g, 0.08) AS g1, least(g * 0.5, 0.04) AS g2 FROM b1), b3 AS (SELECT *, oe * power(1 + g1, 5) AS e1 FROM b2),
  b4 AS (SELECT *, ({pv_sql('oe', 'g1', '0.10', 5)} + {pv_sql('e1', 'g2', '0.10', 5)} / power(1.1, 5) + e1 * power(1 + g2, 5) * 1.025 / 0.075 / power(1.1, 10)) * 0.85 AS iv FROM b3)
  SELECT symbol, {', '.join(f'{c}::DOUBLE AS {c}' for c in ('fundamentals', 'consistency', 'moat', 'pricing_power', 'book_value', 'management'))},
    (fundamentals + consistency + moat + pricing_power + book_value + management)::DOUBLE AS score, 27.0::DOUBLE AS max_score, {r('oe', 2)} AS owner_earnings, {r('(iv - cap) / cap', 4)} AS margin_of_safety FROM b4""")
def _(spark, sf):
    b = screens.screen_buffett(pan(spark, sf), AS_OF)
    return tidy(b.withColumn("owner_earnings", F.round("owner_earnings", 2)), 4)


_mad = lambda a: f"list_avg(list_transform({a}, lambda v: abs(v - list_avg({a}))))"
_gr = "list_transform(range(1, len(revenue)), lambda i: revenue[i] / revenue[i + 1] - 1)"
_hit = "len(list_filter(return_on_invested_capital, lambda v: v > 0.15))"
_mup = f"len(list_filter(range(1, len({_gm})), lambda i: {_gm}[i] >= {_gm}[i + 1]))"
_conv = f"list_filter(list_transform(range(1, len({_ni}) + 1), lambda i: CASE WHEN {_ni}[i] > 0 THEN {_fcf}[i] / {_ni}[i] END), lambda v: v IS NOT NULL)"
_cr, _sh = "(cash_and_equivalents[1] / revenue[1])", "outstanding_shares"
_r3, _o3 = f"list_avg({_fcf}[1:3])", L["old"](_fcf)


@query("k08_munger", f"""{PROF[10]}, {INSIDER_AT}, m0 AS (SELECT *, CASE WHEN len({_fcf}) >= 3 AND list_avg({_fcf}[1:5]) > 0 THEN list_avg({_fcf}[1:5]) / market_cap_0 END AS y,
    CASE WHEN len({_fcf}) >= 3 AND list_avg({_fcf}[1:5]) > 0 THEN (list_avg({_fcf}[1:5]) * 15 - market_cap_0) / market_cap_0 END AS mos, buys / nullif(buys + sells, 0) AS br,
    CASE WHEN len(total_debt) = len(shareholders_equity) THEN CASE WHEN shareholders_equity[1] > 0 THEN total_debt[1] / shareholders_equity[1] ELSE 1e99 END END AS de FROM prof LEFT JOIN flow USING (symbol)),
  m1 AS (SELECT symbol, y, mos, br, de, {_cr} AS cr, {_sh}[1] < {_sh}[-1] * 0.95 AS scf,
    least(10, (CASE WHEN {_hit} >= len(return_on_invested_capital) * 0.8 THEN 3 WHEN {_hit} >= len(return_on_invested_capital) * 0.5 THEN 2 WHEN {_hit} > 0 THEN 1 ELSE 0 END
      + CASE WHEN {_mup} >= len({_gm}) * 0.7 THEN 2 WHEN list_avg({_gm}) > 0.3 THEN 1 ELSE 0 END + {case("list_avg(list_transform(range(1, len(revenue) + 1), lambda i: abs(capital_expenditure[i]) / revenue[i]))", [(0.05, 2), (0.10, 1)], op='<')}
      + {fl('list_sum(research_and_development) > 0')} + 1) * 10 / 9) AS moat,
    greatest(0, least(10, ({case(f'list_avg({_conv})', [(1.1, 3), (0.9, 2), (0.7, 1)])} + {case('de', [(0.3, 3), (0.7, 2), (1.5, 1)], op='<')}
      + CASE WHEN {_cr} BETWEEN 0.1 AND 0.25 THEN 2 WHEN ({_cr} >= 0.05 AND {_cr} < 0.1) OR ({_cr} > 0.25 AND {_cr} <= 0.4) THEN 1 ELSE 0 END
      + CASE WHEN br > 0.7 THEN 2 WHEN br > 0.4 THEN 1 WHEN br < 0.1 AND sells > 5 THEN -1 ELSE 0 END
      + CASE WHEN {_sh}[1] < {_sh}[-1] * 0.95 THEN 2 WHEN {_sh}[1] < {_sh}[-1] * 1.05 THEN 1 WHEN {_sh}[1] > {_sh}[-1] * 1.2 THEN -1 ELSE 0 END) * 10 / 12)) AS management,
    least(10, CASE WHEN list_avg({_gr}) > 0.05 AND {_mad(_gr)} < 0.1 THEN 3 WHEN list_avg({_gr}) > 0 AND {_mad(_gr)} < 0.2 THEN 2 WHEN list_avg({_gr}) > 0 THEN 1 ELSE 0 END
      + CASE WHEN len(list_filter({_oi}, lambda v: v > 0)) = len({_oi}) THEN 3 WHEN len(list_filter({_oi}, lambda v: v > 0)) >= len({_oi}) * 0.8 THEN 2 WHEN len(list_filter({_oi}, lambda v: v > 0)) >= len({_oi}) * 0.6 THEN 1 ELSE 0 END
      + {case(_mad(_om), [(0.03, 2), (0.07, 1)], op='<')} + CASE WHEN len(list_filter({_fcf}, lambda v: v > 0)) = len({_fcf}) THEN 2 WHEN len(list_filter({_fcf}, lambda v: v > 0)) >= len({_fcf}) * 0.8 THEN 1 ELSE 0 END) AS predictability,
    CASE WHEN y IS NOT NULL THEN least(10, {case('y', [(0.08, 4), (0.05, 3), (0.03, 1)])} + {case('mos', [(0.3, 3), (0.1, 2), (-0.1, 1)])} + CASE WHEN {_r3} > ({_o3}) * 1.2 THEN 3 WHEN {_r3} > {_o3} THEN 2 ELSE 0 END) ELSE 0 END AS valuation FROM m0),
  m2 AS (SELECT *, moat * 0.35 + management * 0.25 + predictability * 0.25 + valuation * 0.15 AS score, 100 * (0.35 * moat + 0.25 * management + 0.25 * predictability) / 8.5 AS q, coalesce(mos, 0) AS m FROM m1),
  m3 AS (SELECT *, CASE WHEN score >= 7.5 THEN 'bullish' WHEN score <= 5.5 THEN 'bearish' ELSE 'neutral' END AS signal, 0.85 * q + 0.15 * valuation * 10 + greatest(-10, least(10, m * 100 / 3)) AS raw FROM m2)
  SELECT symbol, {rcols('moat management predictability valuation score', 4)}, 10.0::DOUBLE AS max_score, signal,
    {r('''round_even(greatest(CASE signal WHEN 'bullish' THEN CASE WHEN q >= 55 THEN 50 ELSE 30 END WHEN 'bearish' THEN CASE WHEN m < -0.05 THEN 10 ELSE 30 END ELSE 50 END,
      least(CASE signal WHEN 'bullish' THEN CASE WHEN m > 0 THEN 100 ELSE 69 END WHEN 'bearish' THEN 49 ELSE 69 END, raw)), 0)''', 2)} AS confidence, {r('mos', 4)} AS margin_of_safety, {r('y', 4)} AS fcf_yield,
    round_even(moat, 2) >= 7 AS moat_strong, round_even(predictability, 2) >= 7 AS predictable, round_even(management, 2) >= 7 OR coalesce(br, 0) >= 0.6 AS owner_aligned, coalesce(de < 0.7, false) AS low_leverage,
    coalesce(cr BETWEEN 0.1 AND 0.25, false) AS sensible_cash, m > 0 AS mos_positive, coalesce(y, 0) >= 0.05 AS fcf_yield_ok, scf AS share_count_friendly FROM m3""")
def _(spark, sf):
    return tidy(screens.screen_munger(pan(spark, sf), frames.insider(spark, sf), AS_OF), 4)
