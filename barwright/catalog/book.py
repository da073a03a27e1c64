"""Registered portfolio, ledger, risk and compliance operators."""

from pyspark.sql import functions as F

from barwright.catalog.registry import query, r, rcols, tidy
from barwright.catalog.sqlframes import ACCOUNTS, BARS, FILLS, JOURNAL, POSITIONS, SNAPSHOTS
from barwright.operators import aggs, portfolio, risk
from barwright.sources import frames, universe
from barwright.streaming.jobs import scratch

UNI = ", ".join(
    f"('{m}', {i}, '{sec}', '{label}', '{sym}', {len(syms)}, {cap}::DOUBLE, {per}::DOUBLE)"
    for m, ss in universe.UNIVERSE.items() for i, (sec, label, syms, cap, per) in enumerate(ss) for sym in syms)
UNIVERSE = f"uni(mode, sector_rank, sector, label, symbol, n_symbols, max_sector_pct, max_per_stock_pct) AS (VALUES {UNI})"
SWING = UNIVERSE + ", u AS (SELECT * FROM uni WHERE mode = 'swing')"


def split(spark, sf):
    return portfolio.split_positions(frames.positions(spark, sf))


SPLIT = """split AS (SELECT account, symbol, greatest(qty, 0) AS long, greatest(-qty, 0) AS short,
  CASE WHEN qty > 0 THEN avg_entry_price ELSE 0 END AS long_cost_basis, CASE WHEN qty < 0 THEN avg_entry_price ELSE 0 END AS short_cost_basis FROM positions),
  val AS (SELECT account, symbol, long, short, long * price AS lv, short * price AS sv, price FROM split JOIN marks USING (symbol))"""


@query("p14_daily_pnl", f"""WITH {ACCOUNTS} SELECT account, {r('equity - last_equity', 2)} AS daily_pnl,
  {r('CASE WHEN last_equity > 0 THEN (equity - last_equity) / last_equity ELSE 0 END')} AS daily_pnl_pct FROM accounts""")
def _(spark, sf):
    a = portfolio.daily_pnl(frames.accounts(spark, sf))
    return a.select("account", F.round("daily_pnl", 2).alias("daily_pnl"), F.round("daily_pnl_pct", 6).alias("daily_pnl_pct"))


@query("d12_split_positions", f"""WITH {POSITIONS}, {SPLIT} SELECT account, symbol, long, short, {r('long_cost_basis', 4)} AS long_cost_basis,
  {r('short_cost_basis', 4)} AS short_cost_basis FROM split""")
def _(spark, sf):
    return tidy(split(spark, sf), 4)


@query("j07_value_positions", f"""WITH {POSITIONS}, {SPLIT} SELECT account, symbol, {r('lv', 2)} AS long_value, {r('sv', 2)} AS short_value FROM val""")
def _(spark, sf):
    v = portfolio.value_positions(split(spark, sf), frames.marks(spark, sf))
    return tidy(v.select("account", "symbol", "long_value", "short_value"), 2)


@query("a08_portfolio_value", f"""WITH {ACCOUNTS}, {SPLIT} SELECT a.account, {r('any_value(cash)', 2)} AS cash_balance, {r('coalesce(sum(lv - sv), 0)', 2)} AS total_position_value,
  {r('any_value(cash) + coalesce(sum(lv - sv), 0)', 2)} AS total_value, {r('((any_value(cash) + coalesce(sum(lv - sv), 0)) / 1e7 - 1) * 100', 4)} AS return_pct
  FROM accounts a LEFT JOIN val USING (account) GROUP BY 1""")
def _(spark, sf):
    v = portfolio.value_positions(split(spark, sf), frames.marks(spark, sf))
    s = portfolio.portfolio_summary(portfolio.portfolio_value(v, frames.accounts(spark, sf)), 1e7)
    return tidy(s.withColumn("return_pct", F.round("return_pct", 4)).select(
        "account", *[F.round(c, 2).alias(c) for c in ("cash_balance", "total_position_value", "total_value")], "return_pct"))


@query("a09_exposures", f"""WITH {POSITIONS}, {SPLIT}, g AS (SELECT account, sum(lv) AS l, sum(sv) AS s FROM val GROUP BY 1)
  SELECT account, {r('l', 2)} AS long_exposure, {r('s', 2)} AS short_exposure, {r('l + s', 2)} AS gross_exposure, {r('l - s', 2)} AS net_exposure,
  {r('CASE WHEN s > 1e-9 THEN l / s END', 2)} AS long_short_ratio FROM g""")
def _(spark, sf):
    v = portfolio.value_positions(split(spark, sf), frames.marks(spark, sf))
    return tidy(portfolio.exposures(v, inf_as_null=True), 2)


@query("a11_day_report", f"""WITH {FILLS}, d AS (SELECT day AS date, symbol, sum(CASE WHEN action = 'buy' THEN qty ELSE 0 END) AS long,
    sum(CASE WHEN action = 'short' THEN qty ELSE 0 END) AS short, arg_max(price, (l_shipdate, l_orderkey, l_linenumber, l_partkey, account)) AS price FROM fills GROUP BY 1, 2)
  SELECT date, symbol, CAST(sum(long) AS BIGINT) AS long_shares, CAST(sum(short) AS BIGINT) AS short_shares, {r('sum((long - short) * price)', 2)} AS position_value
  FROM d GROUP BY GROUPING SETS ((date, symbol), (date))""")
def _(spark, sf):
    f = frames.fills(spark, sf)
    day = f.groupBy(F.col("day").alias("date"), "symbol").agg(
        F.sum(F.when(F.col("action") == "buy", F.col("qty")).otherwise(0)).alias("long"),
        F.sum(F.when(F.col("action") == "short", F.col("qty")).otherwise(0)).alias("short"),
        F.max_by("price", F.struct("seq", "account")).alias("price"))
    day = day.withColumn("long_value", F.col("long") * F.col("price")).withColumn("short_value", F.col("short") * F.col("price"))
    return tidy(portfolio.day_report(day, ()), 2)


@query("a07_sector_allocation", f"""WITH {ACCOUNTS}, {SWING}, s AS (SELECT account, coalesce(sector, 'other') AS sector, sum(market_value) AS v
    FROM positions LEFT JOIN u USING (symbol) GROUP BY 1, 2)
  SELECT account, sector, {r('v', 2)} AS value, {r('v / equity * 100', 2)} AS pct FROM s JOIN accounts USING (account)""")
def _(spark, sf):
    return tidy(portfolio.sector_allocation(frames.positions(spark, sf), frames.accounts(spark, sf), spark, "swing"), 2)


@query("j04_with_sector", f"""WITH {POSITIONS}, {SWING} SELECT account, symbol, coalesce(sector, 'legacy') AS sector FROM positions LEFT JOIN u USING (symbol)""")
def _(spark, sf):
    return universe.with_sector(frames.positions(spark, sf), spark, "swing", "legacy").select("account", "symbol", "sector")


@query("j05_out_of_universe", f"""WITH {POSITIONS}, {SWING} SELECT account, symbol, {r('market_value', 2)} AS market_value FROM positions
  WHERE symbol NOT IN (SELECT symbol FROM u) AND market_value > 100""")
def _(spark, sf):
    return tidy(risk.out_of_universe(frames.positions(spark, sf), spark, "swing", 100).select("account", "symbol", "market_value"), 2)


@query("j06_in_universe", f"""WITH {POSITIONS}, {SWING} SELECT account, symbol, qty FROM positions WHERE symbol IN (SELECT symbol FROM u)""")
def _(spark, sf):
    return risk.in_universe(frames.positions(spark, sf), spark, "swing").select("account", "symbol", "qty")


@query("a36_allocation_drift", f"""WITH {ACCOUNTS}, {SPLIT}, {SWING}, c AS (SELECT account, symbol, coalesce(long * long_cost_basis, 0) AS cost FROM split),
  t AS (SELECT account, sum(cost) + any_value(cash) AS t FROM c JOIN accounts USING (account) GROUP BY 1),
  w AS (SELECT account, symbol, sector, cost / t AS w, max_sector_pct, n_symbols FROM c JOIN t USING (account) LEFT JOIN u USING (symbol) WHERE t > 0),
  x AS (SELECT *, sum(w) OVER (PARTITION BY account, sector) AS sw FROM w)
  SELECT account, symbol, coalesce(sector, 'outside') AS sector, {r('w')} AS weight, {r('CASE WHEN sector IS NULL THEN 0 ELSE sw END')} AS sector_weight,
  {r('CASE WHEN sector IS NULL THEN 0 ELSE sw - max_sector_pct END')} AS sector_drift, {r('coalesce(max_sector_pct / n_symbols, 0)')} AS target,
  {r('w - coalesce(max_sector_pct / n_symbols, 0)')} AS drift FROM x""")
def _(spark, sf):
    return tidy(portfolio.allocation_drift(split(spark, sf), frames.accounts(spark, sf), spark, "swing"))


@query("p13_big_movers", f"""WITH {POSITIONS} SELECT account, symbol, {r('unrealized_plpc')} AS unrealized_plpc FROM positions WHERE abs(unrealized_plpc * 100) > 5""")
def _(spark, sf):
    return tidy(risk.big_movers(frames.positions(spark, sf)).select("account", "symbol", "unrealized_plpc"))


@query("p13_pulse", f"""WITH {BARS}, p AS (SELECT symbol, ts, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS prev_close, close AS current FROM bars)
  SELECT symbol, ts, prev_close, current, {r('(current - prev_close) / prev_close * 100')} AS change_pct FROM p WHERE abs((current - prev_close) / prev_close * 100) > 3""")
def _(spark, sf):
    from barwright.operators.windows import prev_close
    b = prev_close(frames.bars(spark, sf)).select("symbol", "ts", "prev_close", F.col("close").alias("current"))
    return tidy(risk.pulse(b))


# -- decisions --------------------------------------------------------------------------

RAW = """raw AS (SELECT o_orderkey AS decision, o_custkey AS account, CASE left(o_orderpriority, 1) WHEN '1' THEN 'buy' WHEN '2' THEN 'sell' WHEN '3' THEN 'short'
  WHEN '4' THEN 'nonsense' ELSE 'hold' END AS action, CASE WHEN o_orderstatus = 'P' THEN 'n/a' ELSE CAST((o_orderkey % 1000) - 100 AS VARCHAR) END AS quantity FROM orders)"""


def raw_decisions(spark, sf):
    o = frames.table(spark, sf, "orders")
    p = F.substring("o_orderpriority", 1, 1)
    return o.select(
        F.col("o_orderkey").alias("decision"), F.col("o_custkey").alias("account"),
        F.when(p == "1", "buy").when(p == "2", "sell").when(p == "3", "short").when(p == "4", "nonsense").otherwise("hold").alias("action"),
        F.when(F.col("o_orderstatus") == "P", "n/a").otherwise((F.col("o_orderkey") % 1000 - 100).cast("string")).alias("quantity"))


NORM = """norm AS (SELECT c_custkey AS account, decision, CASE WHEN action IN ('buy', 'sell', 'short', 'cover', 'hold') THEN action ELSE 'hold' END AS action,
  coalesce(TRY_CAST(quantity AS DOUBLE), 0) AS quantity FROM customer LEFT JOIN raw ON account = c_custkey)"""


def normalized(spark, sf):
    want = frames.table(spark, sf, "customer").select(F.col("c_custkey").alias("account"))
    return portfolio.normalize_decisions(raw_decisions(spark, sf), want, ("account",))


@query("p08_normalize_decisions", f"WITH {RAW}, {NORM} SELECT * FROM norm")
def _(spark, sf):
    return normalized(spark, sf)


@query("p09_decisions_to_trades", f"WITH {RAW}, {NORM} SELECT account, decision, action, CAST(trunc(quantity) AS BIGINT) AS qty FROM norm WHERE action <> 'hold' AND trunc(quantity) > 0")
def _(spark, sf):
    return tidy(portfolio.decisions_to_trades(normalized(spark, sf)))


# -- ledger -----------------------------------------------------------------------------

def opening(spark, sf):
    return frames.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("account"), F.lit(1_000_000.0).alias("cash"))


ORDERED = "l_shipdate, l_orderkey, l_linenumber, l_partkey"
DONE = f"""{FILLS}, done AS (SELECT *, CASE WHEN action IN ('buy', 'cover') THEN 1 WHEN action IN ('sell', 'short') THEN -1 END AS s FROM fills WHERE action <> 'hold')"""


@query("d13_ledger", f"""WITH {DONE} SELECT account, row_number() OVER w AS n, symbol, day, action, qty, {r('price', 4)} AS price,
    {r('1e6 + sum(-s * qty * price) OVER w', 2)} AS cash, CAST(sum(s * qty) OVER (PARTITION BY account, symbol ORDER BY {ORDERED}) AS BIGINT) AS position
  FROM done WINDOW w AS (PARTITION BY account ORDER BY {ORDERED})""")
def _(spark, sf):
    led = portfolio.ledger(frames.fills(spark, sf), opening(spark, sf))
    return tidy(led.withColumn("cash", F.round("cash", 2)), 4)


@query("d14_symbol_ledger", f"""WITH RECURSIVE {FILLS}, f AS (SELECT *, row_number() OVER (PARTITION BY account, symbol ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS rn
    FROM fills WHERE action IN ('buy', 'sell')),
  s AS (SELECT account, symbol, rn, CASE WHEN action = 'buy' THEN qty ELSE 0 END AS position, CASE WHEN action = 'buy' THEN price ELSE 0.0 END AS basis, CAST(0 AS DOUBLE) AS gain
        FROM f WHERE rn = 1
      UNION ALL
        SELECT f.account, f.symbol, f.rn, CASE WHEN f.action = 'buy' THEN s.position + f.qty ELSE greatest(s.position - f.qty, 0) END,
          CASE WHEN f.action = 'buy' THEN (s.basis * s.position + f.qty * f.price) / (s.position + f.qty) WHEN s.position > f.qty THEN s.basis ELSE 0.0 END,
          s.gain + CASE WHEN f.action = 'sell' THEN (f.price - s.basis) * least(f.qty, s.position) ELSE 0.0 END
        FROM s JOIN f ON f.account = s.account AND f.symbol = s.symbol AND f.rn = s.rn + 1)
  SELECT f.account, f.symbol, f.day, f.action, f.qty, {r('f.price', 3)} AS price, s.position, {r('s.basis', 3)} AS cost_basis, {r('s.gain', 3)} AS realized
  FROM f JOIN s USING (account, symbol, rn)""")
def _(spark, sf):
    return tidy(portfolio.symbol_ledger(frames.fills(spark, sf)), 3)


BOOKS = f"""f AS (SELECT *, CASE WHEN action IN ('buy', 'sell') THEN 'long' ELSE 'short' END AS book, action IN ('buy', 'short') AS opens FROM fills WHERE action <> 'hold' AND qty > 0),
  g AS (SELECT *, row_number() OVER (PARTITION BY account, symbol, book ORDER BY {ORDERED}) AS rn FROM f),
  s AS (SELECT account, symbol, book, rn, CASE WHEN opens THEN qty ELSE 0 END AS position, CASE WHEN opens THEN price ELSE 0.0 END AS basis, CASE WHEN opens THEN qty ELSE 0 END AS executed, CAST(0 AS DOUBLE) AS gain, CASE WHEN opens THEN qty * price ELSE 0.0 END AS freed
        FROM g WHERE rn = 1
      UNION ALL
        SELECT g.account, g.symbol, g.book, g.rn, CASE WHEN opens THEN s.position + g.qty ELSE greatest(s.position - g.qty, 0) END,
          CASE WHEN opens THEN (s.basis * s.position + g.qty * g.price) / (s.position + g.qty) WHEN s.position > g.qty THEN s.basis ELSE 0.0 END,
          CASE WHEN opens THEN g.qty ELSE least(g.qty, s.position) END,
          s.gain + CASE WHEN opens THEN 0.0 ELSE (g.price - s.basis) * least(g.qty, s.position) * CASE WHEN g.book = 'long' THEN 1 ELSE -1 END END,
          CASE WHEN opens THEN g.qty * g.price ELSE -s.basis * least(g.qty, s.position) END
        FROM s JOIN g ON g.account = s.account AND g.symbol = s.symbol AND g.book = s.book AND g.rn = s.rn + 1),
  e AS (SELECT g.*, s.position, s.basis, s.executed, s.gain, CASE WHEN g.book = 'short' THEN 0.5 * s.freed ELSE 0.0 END AS margin,
      CASE WHEN action IN ('buy', 'cover') THEN -1 ELSE 1 END * s.executed * g.price AS trade FROM g JOIN s USING (account, symbol, book, rn))"""


@query("d13_margin_ledger", f"""WITH RECURSIVE {FILLS}, {BOOKS} SELECT account, row_number() OVER w AS n, symbol, book, day, action, qty, executed, {r('price', 3)} AS price, position, {r('basis', 3)} AS cost_basis, {r('gain', 2)} AS realized,
    {r('1e6 + sum(trade - margin) OVER w', 2)} AS cash, {r('sum(margin) OVER w', 2)} AS margin_used FROM e WINDOW w AS (PARTITION BY account ORDER BY {ORDERED})""")
def _(spark, sf):
    led = portfolio.margin_ledger(frames.fills(spark, sf), opening(spark, sf))
    return tidy(led.withColumns({c: F.round(c, 2) for c in ("realized", "cash", "margin_used")}), 3)


@query("d15_equity_curve", f"""WITH {DONE}, px AS (SELECT symbol, day, arg_max(price, ({ORDERED}, account)) AS price FROM fills GROUP BY 1, 2),
  dl AS (SELECT account, symbol, day, sum(s * qty) AS d, sum(-s * qty * price) AS c FROM done GROUP BY 1, 2, 3),
  ps AS (SELECT account, symbol, day, sum(d) OVER (PARTITION BY account, symbol ORDER BY day) AS pos FROM dl),
  ed AS (SELECT account, day AS date, 1e6 + sum(c) OVER (PARTITION BY account ORDER BY day) AS cash FROM (SELECT account, day, sum(c) AS c FROM dl GROUP BY 1, 2)),
  aim AS (SELECT account, date, symbol FROM ed JOIN (SELECT DISTINCT account, symbol FROM dl) USING (account)),
  had AS (SELECT aim.*, pos FROM aim ASOF JOIN ps ON ps.account = aim.account AND ps.symbol = aim.symbol AND ps.day <= aim.date),
  h AS (SELECT account, date, sum(pos * price) AS v FROM had ASOF JOIN px ON px.symbol = had.symbol AND px.day <= had.date GROUP BY 1, 2)
  SELECT account, date, 1::BIGINT AS seq, {r('cash + coalesce(v, 0)', 2)} AS value FROM ed LEFT JOIN h USING (account, date)
  UNION ALL SELECT account, min(date), 0, 1e6 FROM ed GROUP BY 1""")
def _(spark, sf):
    """The prices are written first, so that their size is known where they meet the positions."""
    f = frames.fills(spark, sf)
    path = scratch(spark, "d15-prices")
    portfolio.daily_prices(f).write.parquet(path)
    return tidy(portfolio.equity_curve(f, spark.read.parquet(path), opening(spark, sf)), 2)


# -- volatility, correlation, limits ----------------------------------------------------

VOLS = """rets AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM bars),
  rv AS (SELECT *, CASE WHEN count(ret) OVER w = 30 THEN stddev_samp(ret) OVER w END AS roll_vol FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 29 PRECEDING)),
  dv AS (SELECT symbol, stddev_samp(ret) AS dv FROM rets WHERE rn <= 60 GROUP BY 1),
  vols AS (SELECT symbol, any_value(dv) AS dv, any_value(dv) * sqrt(252) AS av, avg(CASE WHEN roll_vol IS NOT NULL THEN CAST(roll_vol <= dv AS INT) END) * 100 AS vp,
    count(ret) FILTER (rn <= 60) AS n, arg_max(close, ts) AS price FROM rv JOIN dv USING (symbol) GROUP BY 1)"""

CORR = """cr AS (SELECT symbol, ts, ret FROM rets WHERE ret IS NOT NULL), full_ AS (SELECT ts FROM cr GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT symbol) FROM cr)),
  z AS (SELECT * FROM cr SEMI JOIN full_ USING (ts)), corr AS (SELECT x.symbol AS a, y.symbol AS b, corr(x.ret, y.ret) AS corr FROM z x JOIN z y USING (ts) WHERE x.symbol <> y.symbol GROUP BY 1, 2)"""


@query("a20_correlation_matrix", f"WITH {BARS}, {VOLS}, {CORR} SELECT a, b, {r('corr')} AS corr FROM corr")
def _(spark, sf):
    return tidy(risk.correlation_matrix(frames.bars(spark, sf)))


CTX = """k AS (SELECT a, b, corr, row_number() OVER (PARTITION BY a ORDER BY corr DESC, b) AS rn FROM corr
    WHERE b IN ('MACHINERY', 'FURNITURE') OR a IN (SELECT a FROM corr GROUP BY 1 HAVING count(*) FILTER (b IN ('MACHINERY', 'FURNITURE')) = 0)),
  ctx AS (SELECT a AS symbol, avg(corr) AS ac, max(corr) AS mc, string_agg(b, ',' ORDER BY rn) FILTER (rn <= 3) AS top FROM k GROUP BY 1)"""


def active(spark, sf):
    c = frames.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("symbol")).distinct()
    return c.filter(F.col("symbol").isin("MACHINERY", "FURNITURE"))


@query("a21_correlation_context", f"""WITH {BARS}, {VOLS}, {CORR}, {CTX} SELECT symbol, {r('ac')} AS avg_correlation, {r('mc')} AS max_correlation, top AS top_correlated FROM ctx""")
def _(spark, sf):
    return tidy(risk.correlation_partners(frames.bars(spark, sf), active(spark, sf)))


@query("a22_volatility_pack", f"""WITH {BARS}, {VOLS} SELECT symbol, {r('dv')} AS daily_volatility, {r('av')} AS annualized_volatility, {r('vp')} AS volatility_percentile,
  n AS data_points, price FROM vols""")
def _(spark, sf):
    return tidy(risk.volatility_pack(frames.bars(spark, sf)))


VL = """least(greatest(CASE WHEN av < 0.15 THEN 1.25 WHEN av < 0.30 THEN 1 - (av - 0.15) * 0.5 WHEN av < 0.5 THEN 0.75 - (av - 0.30) * 0.5 ELSE 0.5 END, 0.25), 1.25) * 0.20"""
CM = "CASE WHEN ac IS NULL THEN 1.0 WHEN ac >= 0.8 THEN 0.7 WHEN ac >= 0.6 THEN 0.85 WHEN ac >= 0.4 THEN 1.0 WHEN ac >= 0.2 THEN 1.05 ELSE 1.10 END"


@query("f01_vol_limit", f"""WITH {BARS}, {VOLS}, {CORR}, {CTX} SELECT symbol, {r(VL)} AS vol_limit_pct, {r(CM)} AS corr_multiplier FROM vols JOIN ctx USING (symbol)""")
def _(spark, sf):
    from barwright.functions.numeric import corr_multiplier, vol_limit
    b = frames.bars(spark, sf)
    ctx = risk.correlation_partners(b, active(spark, sf))
    return tidy(risk.volatility_pack(b).join(ctx, "symbol").select(
        "symbol", vol_limit("annualized_volatility").alias("vol_limit_pct"), corr_multiplier("avg_correlation").alias("corr_multiplier")))


SEGPOS = """sp AS (SELECT c_nationkey AS account, c_mktsegment AS symbol, greatest(q, 0) AS long, greatest(-q, 0) AS short FROM
    (SELECT c_nationkey, c_mktsegment, CAST(sum(CASE WHEN c_custkey % 3 = 0 THEN -1 ELSE 1 END) AS BIGINT) AS q FROM customer GROUP BY 1, 2)),
  acc AS (SELECT c_nationkey AS account, abs(sum(c_acctbal)) * 100 AS cash FROM customer GROUP BY 1),
  tv AS (SELECT account, any_value(cash) AS cash, any_value(cash) + sum((long - short) * price) AS tv FROM sp JOIN acc USING (account) JOIN vols USING (symbol) GROUP BY 1)"""


def segment_positions(spark, sf):
    c = frames.table(spark, sf, "customer")
    q = F.sum(F.when(F.col("c_custkey") % 3 == 0, -1).otherwise(1))
    p = c.groupBy(F.col("c_nationkey").alias("account"), F.col("c_mktsegment").alias("symbol")).agg(q.alias("q"))
    p = p.select("account", "symbol", F.greatest("q", F.lit(0)).alias("long"), F.greatest(-F.col("q"), F.lit(0)).alias("short"))
    a = c.groupBy(F.col("c_nationkey").alias("account")).agg((F.abs(F.sum("c_acctbal")) * 100).alias("cash"))
    return p, a


LIM = f"""lim AS (SELECT account, symbol, long, short, price AS current_price, cash, tv, {VL} * {CM} AS pct,
  least(tv * {VL} * {CM} - abs((long - short) * price), cash) AS rem FROM sp JOIN vols USING (symbol) LEFT JOIN ctx USING (symbol) JOIN tv USING (account))"""


def limits(spark, sf):
    b = frames.bars(spark, sf)
    p, a = segment_positions(spark, sf)
    ctx = risk.correlation_partners(b, active(spark, sf))
    return p, a, risk.risk_limits(p, a, risk.volatility_pack(b), ctx)


@query("d01_risk_limits", f"""WITH {BARS}, {VOLS}, {CORR}, {CTX}, {SEGPOS}, {LIM} SELECT account, symbol, {r('current_price', 4)} AS current_price, {r('pct', 4)} AS limit_pct,
  {r('rem', 4)} AS remaining_position_limit FROM lim""")
def _(spark, sf):
    return tidy(limits(spark, sf)[2], 4)


ALLOW = f"""WITH {BARS}, {VOLS}, {CORR}, {CTX}, {SEGPOS}, {LIM},
  m AS (SELECT *, CAST(CASE WHEN current_price > 0 THEN floor(round(rem / current_price, 9)) ELSE 0 END AS BIGINT) AS ms FROM lim),
  q AS (SELECT *, CASE WHEN cash > 0 AND current_price > 0 THEN greatest(0, least(ms, CAST(floor(round(cash / current_price, 9)) AS BIGINT))) ELSE 0 END AS buy,
        CASE WHEN current_price > 0 AND ms > 0 THEN greatest(0, least(ms, CAST(floor(round(greatest(0, tv / 0.5 - 0) / current_price, 9)) AS BIGINT))) ELSE 0 END AS sh FROM m)"""


@query("d02_allowed_actions", f"""{ALLOW} SELECT account, symbol, CASE WHEN buy > 0 THEN buy END AS buy, CASE WHEN long > 0 THEN long END AS sell,
  CASE WHEN sh > 0 THEN sh END AS short, CASE WHEN short > 0 THEN short END AS cover, 0::BIGINT AS hold FROM q""")
def _(spark, sf):
    p, a, lim = limits(spark, sf)
    f = p.join(lim, ["account", "symbol"])
    tv = p.join(lim.select("account", "symbol", "current_price"), ["account", "symbol"]).groupBy("account").agg(
        F.sum((F.col("long") - F.col("short")) * F.col("current_price")).alias("h"))
    f = f.join(a.join(tv, "account").withColumn("equity", F.col("cash") + F.col("h")), "account")
    f = f.withColumn("max_shares", risk.whole_shares(F.col("remaining_position_limit"), F.col("current_price")))
    f = risk.allowed_actions(f.withColumn("margin_requirement", F.lit(0.5)).withColumn("margin_used", F.lit(0.0)))
    return tidy(f.select("account", "symbol", *[F.try_element_at("allowed", F.lit(k)).alias(k) for k in ("buy", "sell", "short", "cover", "hold")]))


@query("j12_decision_frame", f"""WITH {BARS}, {VOLS}, {CORR}, {CTX}, {SEGPOS}, {LIM},
  sg AS (SELECT o_orderkey AS id, o_custkey % 25 AS account, c_mktsegment AS symbol FROM orders JOIN customer ON o_custkey = c_custkey)
  SELECT id, account, symbol, {r('coalesce(current_price, 0)', 4)} AS current_price, {r('coalesce(rem, 0)', 4)} AS remaining_position_limit,
  CAST(coalesce(CASE WHEN current_price > 0 THEN floor(round(rem / current_price, 9)) ELSE 0 END, 0) AS BIGINT) AS max_shares FROM sg LEFT JOIN lim USING (account, symbol)""")
def _(spark, sf):
    o, c = frames.table(spark, sf, "orders"), frames.table(spark, sf, "customer")
    sig = o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 25).alias("account"), F.col("c_mktsegment").alias("symbol"))
    return tidy(risk.decision_frame(sig, limits(spark, sf)[2].drop("limit_pct")), 4)


# -- rules ------------------------------------------------------------------------------

PROP = """prop AS (SELECT l_suppkey AS account, symbol, CASE action WHEN 'hold' THEN 'Wait' ELSE upper(action) END AS action, qty, price AS entry_price, l_orderkey, l_linenumber, l_partkey, l_shipdate
  FROM (SELECT account AS l_suppkey, * EXCLUDE (account) FROM fills))"""


def proposals(spark, sf):
    f = frames.fills(spark, sf)
    return f.select("account", "symbol", F.when(F.col("action") == "hold", "Wait").otherwise(F.upper("action")).alias("action"), "qty",
                    F.col("price").alias("entry_price"), "seq")


STATE = ACCOUNTS + """, ord AS (SELECT l_suppkey AS account, count(*) AS n FROM lineitem WHERE l_returnflag = 'N' AND l_linestatus <> 'F'
    AND CAST(l_shipdate AS DATE) = DATE '1998-06-30' GROUP BY 1),
  opn AS (SELECT account, count(*) FILTER (qty > 0) AS n FROM positions GROUP BY 1),
  state AS (SELECT a.account, equity, cash, coalesce(cash / nullif(equity, 0), 0) AS cash_pct, coalesce((equity - last_equity) / nullif(last_equity, 0), 0) AS daily_pnl_pct,
    ((a.account % 21) - 12) / 200 AS weekly_pnl_pct, coalesce(opn.n, 0) AS open_position_count, coalesce(ord.n, 0) AS trade_count_today
    FROM accounts a LEFT JOIN opn USING (account) LEFT JOIN ord USING (account))"""


def state(spark, sf):
    li = frames.table(spark, sf, "lineitem").filter(F.to_date("l_shipdate") == F.lit("1998-06-30").cast("date"))
    orders = li.select(F.col("l_suppkey").alias("account"), F.when(F.col("l_returnflag") == "N", "buy").otherwise("sell").alias("side"),
                       F.when(F.col("l_linestatus") == "F", "canceled").otherwise("filled").alias("status"))
    acc = frames.accounts(spark, sf)
    weekly = acc.select("account", ((F.col("account") % 21 - 12) / 200).alias("weekly_pnl_pct"))
    return risk.account_state(acc, frames.positions(spark, sf), orders, weekly, spark, "swing")


@query("d05_account_state", f"""WITH {STATE} SELECT account, {r('equity', 2)} AS equity, {r('cash', 2)} AS cash, {r('cash_pct', 4)} AS cash_pct, {r('daily_pnl_pct', 4)} AS daily_pnl_pct,
  {r('weekly_pnl_pct', 4)} AS weekly_pnl_pct, open_position_count, trade_count_today FROM state""")
def _(spark, sf):
    s = state(spark, sf)
    return tidy(s.withColumn("equity", F.round("equity", 2)).withColumn("cash", F.round("cash", 2)), 4)


def rules_sql(mode):
    k = universe.risk(mode)
    lev = ", ".join(f"'{t}'" for t in universe.LEVERAGED)
    moon = ", ".join(f"'{t}'" for t in universe.MOONSHOTS)
    return f"""u AS (SELECT symbol, arg_max(sector, sector_rank) AS sector, arg_max(max_sector_pct, sector_rank) AS cap, arg_max(max_per_stock_pct, sector_rank) AS per
      FROM uni WHERE mode = '{mode}' GROUP BY 1),
    pl AS (SELECT p.account, p.symbol, qty, market_value, sector FROM positions p LEFT JOIN u USING (symbol)),
    sec AS (SELECT account, sector, sum(market_value) AS sv FROM pl WHERE sector IS NOT NULL GROUP BY 1, 2),
    tac AS (SELECT account, sum(market_value) FILTER (sector = 'tactical' OR symbol IN ({moon})) AS tv FROM pl GROUP BY 1),
    chk AS (SELECT p.*, lower(p.action) AS act, s.equity, s.cash, daily_pnl_pct, weekly_pnl_pct, open_position_count, trade_count_today, u.sector, u.cap, u.per,
        h.qty AS hq, coalesce(h.market_value, 0) AS hv, coalesce(sv, 0) AS sv, coalesce(tv, 0) AS tv, p.qty * p.entry_price AS v
      FROM prop p JOIN state s USING (account) LEFT JOIN u ON u.symbol = p.symbol LEFT JOIN positions h ON h.account = p.account AND h.symbol = p.symbol
      LEFT JOIN sec ON sec.account = p.account AND sec.sector = u.sector LEFT JOIN tac ON tac.account = p.account),
    ruled AS (SELECT *, CASE WHEN act IN ('sell', 'cover', 'hold') THEN NULL WHEN act NOT IN ('buy', 'short') THEN 'unknown_action'
      WHEN symbol IN ({lev}) AND {str(not k['allow_leveraged_etfs']).lower()} THEN 'no_leveraged_etfs' WHEN symbol IN ({moon}) THEN 'moonshot_blocked'
      WHEN daily_pnl_pct <= -{k['daily_loss_limit']} THEN 'daily_circuit_breaker' WHEN act = 'buy' AND daily_pnl_pct <= -{k['no_buy_if_down_pct']} THEN 'no_buy_down_pct'
      WHEN weekly_pnl_pct <= -{k['weekly_loss_limit']} THEN 'weekly_circuit_breaker' WHEN trade_count_today >= {k['max_trades_per_day']} THEN 'max_trades_per_day'
      WHEN coalesce(hq, 0) = 0 AND open_position_count >= {k['max_open_positions']} THEN 'max_open_positions'
      WHEN coalesce((cash - v) / nullif(equity, 0), 0) < {k['min_cash_pct']} THEN 'min_cash_reserve'
      WHEN coalesce((hv + v) / nullif(equity, 0), 0) > coalesce(per, {k['max_position_pct']}) THEN 'max_position_size'
      WHEN sector IS NOT NULL AND coalesce((sv + v) / nullif(equity, 0), 0) > cap THEN 'max_sector_pct'
      WHEN {k['max_tactical_pct']} < 1 AND (sector = 'tactical' OR symbol IN ({moon})) AND coalesce((tv + v) / nullif(equity, 0), 0) > {k['max_tactical_pct']} THEN 'max_tactical_pct' END AS rule FROM chk)"""


for _mode in ("swing", "day"):
    @query(f"d03_validate_trades_{_mode}", f"""WITH {STATE}, {UNIVERSE}, {PROP}, {rules_sql(_mode)}
      SELECT account, symbol, act AS action, qty, rule IS NULL AS approved, rule, l_orderkey, l_linenumber, l_partkey FROM ruled""")
    def _(spark, sf, mode=_mode):
        v = risk.validate_trades(proposals(spark, sf), state(spark, sf), frames.positions(spark, sf), spark, mode)
        return tidy(v.select("account", "symbol", "action", "qty", "approved", "rule", "seq.l_orderkey", "seq.l_linenumber", "seq.l_partkey"))


@query("d16_execution_summary", f"""WITH {STATE}, {UNIVERSE}, {PROP}, {rules_sql('day')}
  SELECT account, count(*) AS total_trades, count(*) FILTER (rule IS NULL) AS executed, count(*) FILTER (rule IS NOT NULL) AS blocked FROM ruled GROUP BY 1""")
def _(spark, sf):
    v = risk.validate_trades(proposals(spark, sf), state(spark, sf), frames.positions(spark, sf), spark, "day")
    return tidy(risk.execution_summary(v))


@query("d03_first_proposals", f"""WITH {FILLS}, k AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS rn FROM fills)
  SELECT account, symbol, qty, l_orderkey, l_linenumber FROM k WHERE rn <= 4""")
def _(spark, sf):
    p = risk.first_proposals(proposals(spark, sf), "swing")
    return tidy(p.select("account", "symbol", "qty", "seq.l_orderkey", "seq.l_linenumber"))


@query("d04_validate_positions", f"""WITH {ACCOUNTS}, {PROP}, v AS (SELECT p.account, p.symbol, lower(p.action) AS action, p.qty, p.l_orderkey, p.l_linenumber,
    CASE WHEN lower(action) = 'sell' AND coalesce(h.qty, 0) <= 0 THEN 'no long position' WHEN lower(action) = 'cover' AND coalesce(h.qty, 0) >= 0 THEN 'no short position'
      WHEN current_price > 0 AND p.qty * current_price > equity * 0.15 THEN 'trade too large' END AS reject_reason
    FROM prop p LEFT JOIN positions h USING (account, symbol) LEFT JOIN accounts a ON a.account = p.account)
  SELECT *, reject_reason IS NULL AS valid FROM v""")
def _(spark, sf):
    p = proposals(spark, sf).withColumn("action", F.lower("action"))
    v = risk.validate_positions(p, frames.positions(spark, sf), frames.accounts(spark, sf))
    return tidy(v.select("account", "symbol", "action", "qty", "seq.l_orderkey", "seq.l_linenumber", "reject_reason", "valid"))


@query("d06_audit_trades", f"""WITH {ACCOUNTS}, {PROP} SELECT p.account, p.symbol, p.qty, p.l_orderkey, p.l_linenumber, {r('p.qty * current_price / equity * 100', 4)} AS trade_pct
  FROM prop p JOIN positions h USING (account, symbol) JOIN accounts a ON a.account = p.account WHERE current_price > 0 AND equity > 0 AND p.qty * current_price / equity * 100 > 0.5""")
def _(spark, sf):
    a = risk.audit_trades(proposals(spark, sf), frames.positions(spark, sf), frames.accounts(spark, sf), 0.5)
    return tidy(a.select("account", "symbol", "qty", "seq.l_orderkey", "seq.l_linenumber", "trade_pct"), 4)


@query("d07_concentration_alerts", f"""WITH {ACCOUNTS}, {SWING}, s AS (SELECT account, coalesce(sector, 'other') AS sector, sum(market_value) AS v, coalesce(any_value(max_sector_pct), 0.30) * 100 AS cap
    FROM positions LEFT JOIN u USING (symbol) GROUP BY 1, 2)
  SELECT account, 'position_concentration' AS type, symbol AS subject, {r('market_value / equity * 100', 3)} AS value, {r('8.0', 3)} AS threshold
  FROM positions JOIN accounts USING (account) WHERE equity > 0 AND market_value / equity * 100 > 8
  UNION ALL SELECT account, 'sector_concentration', sector, {r('v / equity * 100', 3)}, {r('cap', 3)} FROM s JOIN accounts USING (account) WHERE equity > 0 AND v / equity * 100 > cap""")
def _(spark, sf):
    return tidy(risk.concentration_alerts(frames.positions(spark, sf), frames.accounts(spark, sf), spark, "swing"), 3)


@query("d08_cash_alerts", f"""WITH {ACCOUNTS} SELECT account, 'low_cash' AS type, {r('cash / equity * 100', 3)} AS value, {r('20.0', 3)} AS threshold FROM accounts WHERE equity > 0 AND cash / equity * 100 < 20""")
def _(spark, sf):
    return tidy(risk.cash_alerts(frames.accounts(spark, sf), "swing"), 3)


@query("d08_drawdown_alerts", f"""WITH {SNAPSHOTS}, g AS (SELECT account, (max(equity) - arg_max(equity, date)) / max(equity) * 100 AS v FROM snapshots GROUP BY 1)
  SELECT account, 'drawdown' AS type, {r('v')} AS value, {r('1.0')} AS threshold FROM g WHERE v > 1""")
def _(spark, sf):
    return tidy(risk.drawdown_alerts(frames.equity(spark, sf), 1.0))


@query("d08_frequency_alerts", f"""WITH {JOURNAL}, g AS (SELECT CAST(timestamp AS DATE) AS day, count(*) AS v FROM journal WHERE status = 'executed' GROUP BY 1)
  SELECT day, 'high_frequency' AS type, v AS value, 4::BIGINT AS threshold FROM g WHERE v > 4""")
def _(spark, sf):
    return tidy(risk.frequency_alerts(frames.journal(spark, sf), "swing"))


@query("d09_stop_check", f"""WITH {POSITIONS}, hi AS (SELECT symbol, max(price) * 0.05 AS h FROM fills GROUP BY 1),
  x AS (SELECT account, symbol, qty, (current_price - avg_entry_price) / avg_entry_price AS fe, (current_price - h) / h AS fh FROM positions LEFT JOIN hi USING (symbol) WHERE qty > 0),
  y AS (SELECT *, CASE WHEN fe <= -0.07 THEN 'hard_stop' WHEN fh <= -0.15 THEN 'trailing_stop' END AS stop_type FROM x),
  z AS (SELECT *, CASE WHEN stop_type IS NULL THEN concat_ws('; ', CASE WHEN fe <= -0.07 * 0.8 THEN 'approaching hard stop' END,
    CASE WHEN fh <= -0.15 * 0.8 THEN 'approaching trailing stop' END) ELSE '' END AS warning FROM y)
  SELECT account, symbol, qty, {r('fe', 5)} AS from_entry, {r('fh', 5)} AS from_high, stop_type, warning FROM z WHERE stop_type IS NOT NULL OR warning <> ''""")
def _(spark, sf):
    highs = frames.fills(spark, sf).groupBy("symbol").agg((F.max("price") * 0.05).alias("intraday_high"))
    return tidy(risk.stop_check(frames.positions(spark, sf), highs, "swing"), 5)


@query("d10_rebalance_plan", f"""WITH {POSITIONS}, {SWING} SELECT account, symbol, 'sell' AS action, qty FROM positions WHERE symbol NOT IN (SELECT symbol FROM u) AND qty > 0""")
def _(spark, sf):
    return tidy(risk.rebalance_plan(frames.positions(spark, sf), spark, "swing"))


@query("d11_flatten_plan", f"""WITH {POSITIONS} SELECT account, symbol, CASE WHEN qty > 0 THEN 'sell' ELSE 'buy' END AS side, abs(qty) AS qty FROM positions WHERE qty <> 0""")
def _(spark, sf):
    return tidy(risk.flatten_plan(frames.positions(spark, sf)))


def order_requests(spark, sf):
    f = frames.fills(spark, sf)
    kind = F.element_at(F.array(*map(F.lit, ["market", "limit", "stop", "oco", "bracket", "trailing_stop"])), (F.col("seq.l_partkey") % 6 + 1).cast("int"))
    price = F.floor(F.col("price"))
    return f.select("action", "seq.l_orderkey", "seq.l_linenumber", "seq.l_partkey", kind.alias("order_type"), price.cast("double").alias("entry_price"),
                    F.when(F.col("qty") % 2 == 0, price + 1.0).alias("limit_price"), F.when(F.col("qty") % 5 == 0, price - 2.0).alias("stop_price"),
                    F.when(F.col("qty") % 7 == 0, price + 3.0).alias("take_profit"), F.when(F.col("qty") % 3 == 0, F.lit(1.5)).alias("trail_percent"))


REQ = """req AS (SELECT action, l_orderkey, l_linenumber, l_partkey, ['market', 'limit', 'stop', 'oco', 'bracket', 'trailing_stop'][CAST(l_partkey % 6 + 1 AS INT)] AS order_type,
    floor(price) AS ref, CASE WHEN qty % 2 = 0 THEN floor(price) + 1 END AS limit_price, CASE WHEN qty % 5 = 0 THEN floor(price) - 2 END AS s0,
    CASE WHEN qty % 7 = 0 THEN floor(price) + 3 END AS t0, CASE WHEN qty % 3 = 0 THEN 1.5 END AS trail_percent FROM fills),
  br AS (SELECT *, CASE WHEN action = 'short' THEN -1 ELSE 1 END AS sg, action IN ('buy', 'cover', 'short') AND order_type NOT IN ('limit', 'stop', 'trailing_stop', 'oco') AS en FROM req),
  b2 AS (SELECT *, coalesce(s0, CASE WHEN en THEN round_even(ref * (1 - sg * 0.07), 2) END) AS stop_price FROM br),
  b3 AS (SELECT *, coalesce(t0, CASE WHEN en AND stop_price IS NOT NULL THEN round_even(ref + sg * abs(ref - stop_price) * 3, 2) END) AS take_profit FROM b2)"""


@query("f05_order_brackets", f"""WITH {FILLS}, {REQ} SELECT action, l_orderkey, l_linenumber, l_partkey, order_type, {r('stop_price', 2)} AS stop_price, {r('take_profit', 2)} AS take_profit FROM b3""")
def _(spark, sf):
    b = risk.order_brackets(order_requests(spark, sf))
    return tidy(b.select("action", "l_orderkey", "l_linenumber", "l_partkey", "order_type", "stop_price", "take_profit"), 2)


@query("f06_order_class", f"""WITH {FILLS}, {REQ} SELECT l_orderkey, l_linenumber, l_partkey, action, CASE WHEN order_type = 'bracket' OR (stop_price IS NOT NULL AND take_profit IS NOT NULL AND order_type <> 'oco') THEN 'bracket'
  WHEN order_type = 'oco' AND stop_price IS NOT NULL AND take_profit IS NOT NULL THEN 'oco' WHEN order_type = 'limit' AND limit_price IS NOT NULL THEN 'limit'
  WHEN order_type = 'stop' AND stop_price IS NOT NULL THEN 'stop' WHEN order_type = 'trailing_stop' AND trail_percent IS NOT NULL THEN 'trailing_stop' ELSE 'market' END AS order_class FROM b3""")
def _(spark, sf):
    return tidy(risk.order_class(risk.order_brackets(order_requests(spark, sf))).select("l_orderkey", "l_linenumber", "l_partkey", "action", "order_class"))
