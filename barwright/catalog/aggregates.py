"""Registered aggregates: bars, sessions, equity curves, trades, journal, news, signals."""

from pyspark.sql import functions as F

from barwright.catalog.registry import query, r, rcols, tidy
from barwright.catalog.sqlframes import (
    BARS, BARS5, EXPERIMENTS, JOURNAL, NEWS, SIGNALS, SNAPSHOTS)
from barwright.operators import aggs
from barwright.sources import frames

TYP = "(high + low + close) / 3"


@query("a01_vwap", f"""WITH {BARS5} SELECT symbol, session, {r(f'CASE WHEN sum(volume) >= 1 THEN sum({TYP} * volume) / sum(volume) END')} AS vwap
  FROM bars5 GROUP BY 1, 2""")
def _(spark, sf):
    return tidy(aggs.vwap(frames.bars5(spark, sf), ("symbol", "session")))


SESSION = f"""sess AS (SELECT symbol, session, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close,
  CAST(sum(volume) AS BIGINT) AS volume, sum({TYP} * volume) / nullif(sum(volume), 0) AS vwap FROM bars5 GROUP BY 1, 2)"""


@query("a02_session_summary", f"""WITH {BARS5}, {SESSION} SELECT symbol, session, {rcols('open high low close')}, volume, {r('vwap')} AS vwap,
  {r('(close - vwap) / vwap * 100')} AS price_vs_vwap_pct FROM sess""")
def _(spark, sf):
    return tidy(aggs.session_summary(frames.bars5(spark, sf)))


@query("a03_premarket", f"""WITH {BARS5} SELECT symbol, session, {r('max(high)')} AS premarket_high, {r('min(low)')} AS premarket_low,
  CAST(sum(volume) AS BIGINT) AS premarket_volume FROM bars5 WHERE et_minute >= 240 AND et_minute < 570 GROUP BY 1, 2""")
def _(spark, sf):
    return tidy(aggs.premarket_summary(frames.bars5(spark, sf)))


@query("a04_benchmark_return", f"""WITH {BARS} SELECT symbol, {r('(arg_max(close, ts) / arg_min(close, ts) - 1) * 100')} AS return_pct
  FROM bars WHERE ts BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' GROUP BY 1""")
def _(spark, sf):
    return tidy(aggs.benchmark_return(frames.bars(spark, sf), "1996-01-01", "2000-12-31"))


PACK = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn, ts >= max(ts) OVER (PARTITION BY symbol) - 90 AS q FROM bars),
  pack AS (SELECT symbol, max(close) FILTER (rn = 1) AS c1, max(close) FILTER (rn = 2) AS c2, max(close) FILTER (rn = 5) AS c5,
    max(close) FILTER (rn = 30) AS c30, arg_min(close, ts) FILTER (q) AS c0, max(high) FILTER (q) AS high_90d, min(low) FILTER (q) AS low_90d,
    avg(volume) FILTER (rn <= 10) AS v10, max(volume) FILTER (rn = 1) AS volume FROM ranked GROUP BY 1)"""


@query("a05_return_pack", f"""WITH {BARS}, {PACK} SELECT symbol, c1 AS current, {r('(c1 - c2) / c2 * 100')} AS change_1d, {r('(c1 - c5) / c5 * 100')} AS change_5d,
  {r('(c1 - c30) / c30 * 100')} AS change_30d, {r('(c1 - c0) / c0 * 100')} AS change_90d, high_90d, low_90d, {r('v10')} AS avg_volume_10d, volume FROM pack""")
def _(spark, sf):
    return tidy(aggs.return_pack(frames.bars(spark, sf)))


@query("a06_trailing_return", f"""WITH {BARS}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM bars)
  SELECT symbol, {r('arg_max(close, ts) / arg_min(close, ts) - 1')} AS trailing_return FROM k WHERE rn <= 22 GROUP BY 1""")
def _(spark, sf):
    return tidy(aggs.trailing_return(frames.bars(spark, sf), 21))


RETS = """e AS (SELECT account, date, equity AS value FROM snapshots),
  d AS (SELECT *, value / lag(value) OVER (PARTITION BY account ORDER BY date) - 1 AS ret FROM e),
  x AS (SELECT *, ret - 0.0434::DOUBLE / 252 AS ex FROM d)"""


def _sharpe(g):
    return f"CASE WHEN {g} >= 2 THEN CASE WHEN stddev_samp(ex) > 1e-12 THEN avg(ex) / stddev_samp(ex) * sqrt(252) ELSE 0 END END"


def _neg_sortino(none):
    sd = "coalesce(stddev_samp(ex) FILTER (ex < 0), 0)"
    return f"CASE WHEN {sd} > 1e-12 THEN avg(ex) / {sd} * sqrt(252) WHEN avg(ex) > 0 THEN {none} ELSE 0 END"


@query("a12a_perf_engine", f"""WITH {SNAPSHOTS}, {RETS} SELECT account, {r(_sharpe('count(ret)'))} AS sharpe_ratio,
  {r("avg(ex) / sqrt(avg(CASE WHEN ex IS NOT NULL THEN least(ex, 0) * least(ex, 0) END)) * sqrt(252)")} AS sortino_ratio FROM x GROUP BY 1""")
def _(spark, sf):
    return tidy(aggs.perf_metrics(frames.equity(spark, sf), "engine"))


@query("a12b_perf_fast", f"""WITH {SNAPSHOTS}, {RETS} SELECT account, {r(_sharpe('count(ret) + 1'))} AS sharpe_ratio,
  {r(f'least({_neg_sortino(20)}, 20)')} AS sortino_ratio FROM x GROUP BY 1""")
def _(spark, sf):
    return tidy(aggs.perf_metrics(frames.equity(spark, sf), "fast"))


@query("a12c_perf_service", f"""WITH {SNAPSHOTS}, {RETS} SELECT account, {r(_sharpe('count(ret)'))} AS sharpe_ratio,
  {r(_neg_sortino('NULL'))} AS sortino_ratio FROM x GROUP BY 1""")
def _(spark, sf):
    return tidy(aggs.perf_metrics(frames.equity(spark, sf), "service"))


@query("a12d_sharpe_21d", f"""WITH {SNAPSHOTS}, {RETS}, k AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY date DESC) AS rn FROM d)
  SELECT account, {r('(avg(ret) - 0.045::DOUBLE / 252) / stddev_samp(ret) * sqrt(252)')} AS sharpe_21d FROM k WHERE rn <= 21 GROUP BY 1""")
def _(spark, sf):
    return tidy(aggs.perf_metrics(frames.equity(spark, sf), "tracker21"))


DD = """e AS (SELECT account, date, equity AS value FROM snapshots),
  pk AS (SELECT *, max(value) OVER (PARTITION BY account ORDER BY date) AS peak FROM e), dd AS (SELECT *, (value - peak) / peak AS dd FROM pk)"""


@query("a13_max_drawdown", f"""WITH {SNAPSHOTS}, {DD} SELECT account, {r('min(dd) * 100')} AS max_drawdown,
  CASE WHEN min(dd) < 0 THEN arg_min(date, (dd, date)) END AS max_drawdown_date FROM dd GROUP BY 1""")
def _(spark, sf):
    return tidy(aggs.max_drawdown(frames.equity(spark, sf)))


@query("w20_drawdown", f"WITH {SNAPSHOTS}, {DD} SELECT account, date, {r('value', 3)} AS value, {r('peak', 3)} AS peak, {r('dd')} AS drawdown FROM dd")
def _(spark, sf):
    from barwright.operators.windows import drawdown
    d = drawdown(frames.equity(spark, sf))
    return d.select("account", "date", F.round("value", 3).alias("value"), F.round("peak", 3).alias("peak"), F.round("drawdown", 6).alias("drawdown"))


@query("a14_current_drawdown", f"""WITH {SNAPSHOTS} SELECT account, {r('max(equity)', 3)} AS peak, {r('arg_max(equity, date)', 3)} AS current,
  {r('(max(equity) - arg_max(equity, date)) / max(equity) * 100', 3)} AS drawdown_pct FROM snapshots GROUP BY 1""")
def _(spark, sf):
    return tidy(aggs.current_drawdown(frames.equity(spark, sf)), 3)


@query("a15_day_stats", f"""WITH {SNAPSHOTS}, {RETS}, p AS (SELECT *, ret * 100 AS pct FROM d WHERE ret IS NOT NULL)
  SELECT account, count(*) FILTER (pct >= 0) AS win_days, count(*) FILTER (pct < 0) AS lose_days,
  arg_max(date, (pct, -epoch(date))) AS best_day, {r('max(pct)')} AS best_pct, arg_min(date, (pct, date)) AS worst_day, {r('min(pct)')} AS worst_pct,
  {r('round_even(count(*) FILTER (pct >= 0) / count(*) * 100, 1)')} AS win_day_rate FROM p GROUP BY 1""")
def _(spark, sf):
    return tidy(aggs.day_stats(frames.equity(spark, sf)))


def _ends(c):
    return f"(arg_max({c}, date) - arg_min({c}, date)) / arg_min({c}, date) * 100"


@query("a16_alpha_report", f"""WITH {SNAPSHOTS} SELECT account, min(date) AS period_start, max(date) AS period_end, count(*) AS snapshots_count,
  {r(_ends('equity'))} AS portfolio_return_pct, {r(_ends('spy_price'))} AS spy_return_pct, {r(_ends('qqq_price'))} AS qqq_return_pct,
  {r(_ends('equity') + '-' + _ends('spy_price'))} AS alpha_vs_spy, {r(_ends('equity') + '-' + _ends('qqq_price'))} AS alpha_vs_qqq,
  {r('arg_max(cash, date) / arg_max(equity, date) * 100')} AS cash_pct FROM snapshots GROUP BY 1""")
def _(spark, sf):
    return tidy(aggs.alpha_report(frames.snapshots(spark, sf)))


@query("a17_trade_stats", f"""WITH {JOURNAL}, c AS (SELECT *, action IN ('sell', 'cover') AND pnl IS NOT NULL AS closed FROM journal)
  SELECT mode, count(*) AS total_trades, count(*) FILTER (closed) AS closed_trades,
  {r("round_even(count(*) FILTER (closed AND pnl > 0) / count(*) FILTER (closed) * 100, 1)")} AS win_rate,
  {r('avg(pnl) FILTER (closed AND pnl > 0)', 4)} AS avg_win, {r('avg(pnl) FILTER (closed AND pnl <= 0)', 4)} AS avg_loss,
  {r('sum(pnl) FILTER (closed AND pnl > 0) / abs(sum(pnl) FILTER (closed AND pnl <= 0))', 4)} AS profit_factor FROM c GROUP BY 1""")
def _(spark, sf):
    return tidy(aggs.trade_stats(frames.journal(spark, sf), ("mode",)), 4)


STRADES = """trades AS (SELECT c_mktsegment AS account, (o_totalprice - 245000) / 1000 AS pnl FROM orders JOIN customer ON o_custkey = c_custkey),
  ts AS (SELECT account, count(*) AS num_trades, count(*) FILTER (pnl > 0) / count(*) AS win_rate, sum(pnl) FILTER (pnl > 0) AS gp,
    abs(sum(pnl) FILTER (pnl <= 0)) AS gl, avg(pnl) FILTER (pnl > 0) AS avg_win, -avg(pnl) FILTER (pnl <= 0) AS avg_loss FROM trades GROUP BY 1)"""


def segment_trades(spark, sf):
    o, c = frames.table(spark, sf, "orders"), frames.table(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("c_mktsegment").alias("account"), ((F.col("o_totalprice") - 245000) / 1000).alias("pnl"))


@query("a18_strategy_trade_stats", f"""WITH {STRADES} SELECT account, num_trades, {r('win_rate')} AS win_rate, {r('least(gp / gl, 10)')} AS profit_factor,
  {r('gp', 4)} AS gross_profit, {r('gl', 4)} AS gross_loss, {r('avg_win')} AS avg_win, {r('avg_loss')} AS avg_loss FROM ts""")
def _(spark, sf):
    t = aggs.strategy_trade_stats(segment_trades(spark, sf), ("account",))
    return tidy(t.withColumn("gross_profit", F.round("gross_profit", 4)).withColumn("gross_loss", F.round("gross_loss", 4)))


def fitness_sql(mode):
    day = mode == "day"
    w = ("0.35", "0.25", "0.20", "0.10", "0.10") if day else ("0.20", "0.25", "0.35", "0.08", "0.12")
    dd = "CASE WHEN abs(mdd) > 15 THEN 20 ELSE 0 END" if day else "CASE WHEN abs(mdd) > 20 THEN 25 WHEN abs(mdd) > 15 THEN 10 ELSE 0 END"
    low, few, many = ("0.30", 10, 200) if day else ("0.25", 3, 100)
    return f"""least(greatest(sharpe, -5), 10) * {w[0]} + least(greatest(sortino, -5), 20) * {w[1]} + total_return_pct * {w[2]}
      + win_rate * {w[3]} + least(gp / gl, 10) * {w[4]} - {dd} - CASE WHEN win_rate < {low} THEN 10 ELSE 0 END
      - CASE WHEN num_trades < {few} THEN 15 ELSE 0 END - CASE WHEN num_trades > {many} THEN 5 ELSE 0 END"""


@query("a19_fitness", f"""WITH {SNAPSHOTS}, {RETS}, {STRADES},
  m AS (SELECT account, {_sharpe('count(ret) + 1')} AS sharpe, least({_neg_sortino(20)}, 20) AS sortino,
        (arg_max(value, date) / arg_min(value, date) - 1) * 100 AS total_return_pct FROM x GROUP BY 1),
  pk AS (SELECT *, max(value) OVER (PARTITION BY account ORDER BY date) AS peak FROM e),
  mdd AS (SELECT account, min((value - peak) / peak) * 100 AS mdd FROM pk GROUP BY 1)
  SELECT account, {r('total_return_pct')} AS total_return_pct, {r('mdd')} AS max_drawdown,
  {r(fitness_sql('day'))} AS fitness_day, {r(fitness_sql('swing'))} AS fitness_swing FROM m JOIN mdd USING (account) JOIN ts USING (account)""")
def _(spark, sf):
    m = aggs.strategy_metrics(frames.equity(spark, sf), segment_trades(spark, sf), "day").withColumnRenamed("fitness", "fitness_day")
    m = aggs.fitness(m, "swing").withColumnRenamed("fitness", "fitness_swing")
    return tidy(m.select("account", "total_return_pct", "max_drawdown", "fitness_day", "fitness_swing"))


@query("a30_news_sentiment", f"""WITH {NEWS}, g AS (SELECT symbol, count(sentiment) AS articles, count(*) FILTER (sentiment = 'positive') AS bullish,
    count(*) FILTER (sentiment = 'negative') AS bearish, count(*) FILTER (sentiment = 'neutral') AS neutral,
    avg(model_confidence) FILTER (sentiment = 'positive') AS cb, avg(model_confidence) FILTER (sentiment = 'negative') AS cs,
    avg(model_confidence) FILTER (sentiment = 'neutral') AS cn FROM news GROUP BY 1),
  s AS (SELECT *, CASE WHEN bullish > bearish THEN 'bullish' WHEN bearish > bullish THEN 'bearish' ELSE 'neutral' END AS signal FROM g),
  c AS (SELECT *, CASE signal WHEN 'bullish' THEN cb WHEN 'bearish' THEN cs ELSE cn END AS mc, greatest(bullish, bearish) / nullif(articles, 0) * 100 AS sh FROM s)
  SELECT symbol, articles, bullish, bearish, neutral, signal,
  {r('CASE WHEN articles = 0 THEN 0 WHEN mc IS NOT NULL THEN 0.7 * mc + 0.3 * sh ELSE sh END')} AS confidence FROM c""")
def _(spark, sf):
    return tidy(aggs.news_sentiment(frames.news(spark, sf)))


@query("a31_headline_score", f"""WITH {NEWS}, g AS (SELECT symbol, count(*) AS articles,
    count(*) FILTER (contains(lower(title), 'anat') OR contains(lower(title), 'mento')) AS negative FROM news GROUP BY 1)
  SELECT symbol, articles, negative, CAST(CASE WHEN negative > articles * 0.3 THEN 3 WHEN negative > 0 THEN 6 ELSE 8 END AS DOUBLE) AS score FROM g""")
def _(spark, sf):
    return tidy(aggs.headline_score(frames.news(spark, sf), ["anat", "mento"]))


@query("a32_journal_stats", f"""WITH {JOURNAL} SELECT mode, count(*) AS total_entries, count(*) FILTER (status = 'executed') AS executed,
  count(*) FILTER (status = 'blocked') AS blocked, count(*) FILTER (status = 'failed') AS failed,
  count(*) FILTER (status = 'executed' AND action IN ('buy', 'cover')) AS buys, count(*) FILTER (status = 'executed' AND action IN ('sell', 'short')) AS sells,
  count(DISTINCT ticker) FILTER (status = 'executed') AS unique_tickers, count(DISTINCT CAST(timestamp AS DATE)) FILTER (status = 'executed') AS active_days
  FROM journal GROUP BY 1""")
def _(spark, sf):
    return tidy(aggs.journal_stats(frames.journal(spark, sf), ("mode",)))


@query("a32_journal_daily", f"""WITH {JOURNAL} SELECT CAST(timestamp AS DATE) AS day, count(*) FILTER (action IN ('buy', 'cover')) AS buys,
  count(*) FILTER (action NOT IN ('buy', 'cover')) AS sells, count(*) AS total FROM journal WHERE status = 'executed' GROUP BY 1 ORDER BY 1 DESC LIMIT 10""")
def _(spark, sf):
    return tidy(aggs.journal_daily(frames.journal(spark, sf)))


@query("a32_most_traded", f"""WITH {JOURNAL} SELECT ticker, count(*) AS trades FROM journal WHERE status = 'executed' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def _(spark, sf):
    return tidy(aggs.most_traded(frames.journal(spark, sf)))


@query("a33_weekly_pnl", f"""WITH {SNAPSHOTS}, wk AS (SELECT account, arg_min(equity, date) AS base FROM snapshots
    WHERE date BETWEEN DATE '1998-06-23' AND DATE '1998-06-30' GROUP BY 1),
  nw AS (SELECT account, arg_max(equity, date) AS equity FROM snapshots WHERE date <= DATE '1998-06-30' GROUP BY 1)
  SELECT account, {r('CASE WHEN base IS NULL OR base <= 0 OR abs(equity - base) / base > 0.25 THEN 0 ELSE (equity - base) / base END')} AS weekly_pnl_pct
  FROM nw LEFT JOIN wk USING (account)""")
def _(spark, sf):
    s = frames.snapshots(spark, sf).withColumn("mode", F.lit("unknown"))
    now = s.filter(F.col("date") <= F.lit("1998-06-30").cast("date")).groupBy("account").agg(F.max_by("equity", "date").alias("equity"))
    return tidy(aggs.weekly_pnl(s, now, "1998-06-30", "swing"))


@query("a34_signal_counts", f"""WITH {SIGNALS} SELECT date, symbol, count(*) FILTER (signal = 'bullish') AS bullish,
  count(*) FILTER (signal = 'bearish') AS bearish, count(*) FILTER (signal = 'neutral') AS neutral FROM signals GROUP BY 1, 2""")
def _(spark, sf):
    return tidy(aggs.signal_counts(frames.signals(spark, sf)))


def regime_case(rng, chg):
    return f"""CASE WHEN {chg} IS NULL THEN 'unknown' WHEN {rng} > 2.5 THEN 'volatile' WHEN {chg} > 0.5 THEN 'trending_up'
      WHEN {chg} < -0.5 THEN 'trending_down' ELSE 'range_bound' END"""


@query("a35_session_regime", f"""WITH {BARS5}, g AS (SELECT session, arg_min(open, ts) FILTER (symbol = 'view') AS o, arg_max(close, ts) FILTER (symbol = 'view') AS c,
    max(high) FILTER (symbol = 'view') AS h, min(low) FILTER (symbol = 'view') AS l,
    arg_min(open, ts) FILTER (symbol = 'click') AS qo, arg_max(close, ts) FILTER (symbol = 'click') AS qc
    FROM bars5 WHERE symbol IN ('view', 'click') GROUP BY 1),
  v AS (SELECT session, (c - o) / nullif(o, 0) * 100 AS chg, (h - l) / nullif(o, 0) * 100 AS rng, (qc - qo) / nullif(qo, 0) * 100 AS q FROM g)
  SELECT session, {regime_case('rng', 'chg')} AS regime, {r('coalesce(chg, 0)')} AS spy_change_pct, {r('coalesce(q, 0)')} AS qqq_change_pct FROM v""")
def _(spark, sf):
    return tidy(aggs.session_regime(frames.bars5(spark, sf), *frames.anchors()))


@query("a40_trades_per_day", f"""WITH {JOURNAL} SELECT CAST(timestamp AS DATE) AS day, count(*) AS trades FROM journal WHERE status = 'executed' GROUP BY 1""")
def _(spark, sf):
    return tidy(aggs.trades_per_day(frames.journal(spark, sf)))
