"""Registered window and fold indicators (daily bars)."""

from pyspark.sql import functions as F

from barwright.catalog.registry import query, r, rcols, tidy
from barwright.catalog.sqlframes import BARS
from barwright.operators import folds, windows as win
from barwright.sources import frames

W_ = "PARTITION BY symbol ORDER BY ts"


def roll(agg, x, n):
    over = f"OVER ({W_} ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({x}) {over} = {n} THEN {agg}({x}) {over} END"


RET = f"""{BARS}, rets AS (SELECT *, close / lag(close) OVER ({W_}) - 1 AS ret FROM bars)"""


@query("w01_returns", f"WITH {RET} SELECT symbol, ts, {r('ret')} AS ret FROM rets")
def _(spark, sf):
    return tidy(win.returns(frames.bars(spark, sf)).select("symbol", "ts", "ret"))


@query("w02_sma", f"WITH {BARS} SELECT symbol, ts, {r(roll('avg', 'close', 20))} AS sma_20, {r(roll('avg', 'close', 50))} AS sma_50 FROM bars")
def _(spark, sf):
    return tidy(win.sma(win.sma(frames.bars(spark, sf), 20), 50).select("symbol", "ts", "sma_20", "sma_50"))


@query("w03_zscore", f"""WITH {BARS} SELECT symbol, ts,
  {r(f"(close - {roll('avg', 'close', 50)}) / ({roll('stddev_samp', 'close', 50)})")} AS zscore FROM bars""")
def _(spark, sf):
    return tidy(win.zscore(frames.bars(spark, sf)).select("symbol", "ts", "zscore"))


@query("w04_bollinger", f"""WITH {BARS}, b AS (SELECT symbol, ts, close,
    {roll('avg', 'close', 20)} AS m, {roll('stddev_samp', 'close', 20)} AS s FROM bars)
  SELECT symbol, ts, {r('m + 2*s')} AS bb_upper, {r('m - 2*s')} AS bb_lower,
         {r('(close - (m - 2*s)) / ((m + 2*s) - (m - 2*s))')} AS pct_b FROM b""")
def _(spark, sf):
    return tidy(win.bollinger(frames.bars(spark, sf)).select("symbol", "ts", "bb_upper", "bb_lower", "pct_b"))


MOVES = f"""{BARS}, m AS (SELECT *, close - lag(close) OVER ({W_}) AS mv FROM bars),
  ud AS (SELECT symbol, ts, mv, CASE WHEN mv > 0 THEN mv ELSE 0 END AS u0, CASE WHEN mv < 0 THEN -mv ELSE 0 END AS d0,
         CASE WHEN mv IS NOT NULL THEN greatest(mv, 0) END AS u1, CASE WHEN mv IS NOT NULL THEN greatest(-mv, 0) END AS d1 FROM m)"""


@query("w05_rsi", f"""WITH {MOVES}, a AS (SELECT symbol, ts, {roll('avg', 'u0', 14)} AS g, {roll('avg', 'd0', 14)} AS l FROM ud)
  SELECT symbol, ts, {r('CASE WHEN l = 0 AND g > 0 THEN 100 WHEN l = 0 THEN NULL ELSE 100 - 100 / (1 + g / l) END')} AS rsi_14 FROM a""")
def _(spark, sf):
    return tidy(win.rsi(frames.bars(spark, sf), 14).select("symbol", "ts", "rsi_14"))


@query("w06_rsi_strict", f"""WITH {MOVES}, a AS (SELECT symbol, ts, {roll('avg', 'u1', 10)} AS g, {roll('avg', 'd1', 10)} AS l FROM ud)
  SELECT symbol, ts, {r('CASE WHEN g IS NULL THEN NULL WHEN l <= 1e-10 THEN 100 ELSE round_even(100 - 100 / (1 + g / l), 2) END')} AS rsi_10 FROM a""")
def _(spark, sf):
    return tidy(win.rsi(frames.bars(spark, sf), 10, "strict", eps=1e-10).select("symbol", "ts", "rsi_10"))


def ema_sql(source, x, n, name):
    k = f"(CAST(2 AS DOUBLE)/{n + 1})"
    return f"""{name} AS (SELECT symbol, rn, CAST({x} AS DOUBLE) AS v FROM {source} WHERE rn = 1
      UNION ALL SELECT s.symbol, s.rn, s.{x} * {k} + e.v * (1 - {k}) FROM {name} e JOIN {source} s ON s.symbol = e.symbol AND s.rn = e.rn + 1)"""


NUM = f"{BARS}, nb AS (SELECT *, row_number() OVER ({W_}) AS rn FROM bars)"


@query("w07_ema", f"""WITH RECURSIVE {NUM}, {ema_sql('nb', 'close', 8, 'e8')}, {ema_sql('nb', 'close', 55, 'e55')}
  SELECT symbol, ts, {r('e8.v', 4)} AS ema_8, {r('e55.v', 4)} AS ema_55 FROM nb JOIN e8 USING (symbol, rn) JOIN e55 USING (symbol, rn)""")
def _(spark, sf):
    b = folds.emas(frames.bars(spark, sf), "close", {"ema_8": 8, "ema_55": 55})
    return tidy(b.select("symbol", "ts", "ema_8", "ema_55"), 4)


def ewm_sql(source, x, name, n=14):
    a = f"(1 - CAST(2 AS DOUBLE)/{n + 1})"
    return f"""{name} AS (SELECT symbol, rn, coalesce({x}, 0.0) AS num, CASE WHEN {x} IS NULL THEN 0.0 ELSE CAST(1 AS DOUBLE) END AS den
        FROM {source} WHERE rn = 1
      UNION ALL SELECT s.symbol, s.rn, e.num * {a} + coalesce(s.{x}, 0.0), e.den * {a} + CASE WHEN s.{x} IS NULL THEN 0 ELSE 1 END
        FROM {name} e JOIN {source} s ON s.symbol = e.symbol AND s.rn = e.rn + 1)"""


ADX = f"""{NUM}, mv AS (SELECT symbol, rn, ts, greatest(high - low, abs(high - lag(close) OVER ({W_})), abs(low - lag(close) OVER ({W_}))) AS tr,
    high - lag(high) OVER ({W_}) AS up, lag(low) OVER ({W_}) - low AS dn FROM nb),
  dm AS (SELECT symbol, rn, ts, tr, CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0 END AS p, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END AS m FROM mv),
  {ewm_sql('dm', 'tr', 'et')}, {ewm_sql('dm', 'p', 'ep')}, {ewm_sql('dm', 'm', 'em')},
  di AS (SELECT symbol, rn, 100 * (ep.num / ep.den) / nullif(et.num / et.den, 0) AS pdi, 100 * (em.num / em.den) / nullif(et.num / et.den, 0) AS mdi
         FROM et JOIN ep USING (symbol, rn) JOIN em USING (symbol, rn)),
  dx AS (SELECT *, 100 * abs(pdi - mdi) / nullif(pdi + mdi, 0) AS dx FROM di), {ewm_sql('dx', 'dx', 'ed')}"""


@query("w08_adx", f"""WITH RECURSIVE {ADX} SELECT symbol, ts, {r('ed.num / nullif(ed.den, 0)', 4)} AS adx, {r('pdi', 4)} AS plus_di, {r('mdi', 4)} AS minus_di
  FROM nb JOIN dx USING (symbol, rn) JOIN ed USING (symbol, rn)""")
def _(spark, sf):
    return tidy(folds.adx(frames.bars(spark, sf)).select("symbol", "ts", "adx", "plus_di", "minus_di"), 4)


MACD = f"""{NUM}, {ema_sql('nb', 'close', 12, 'ef')}, {ema_sql('nb', 'close', 26, 'es')},
  ln AS (SELECT symbol, rn, ef.v - es.v AS line FROM ef JOIN es USING (symbol, rn)), {ema_sql('ln', 'line', 7, 'sg')}"""


@query("w09_macd", f"""WITH RECURSIVE {MACD} SELECT symbol, ts, {r('CASE WHEN rn >= 33 THEN line END', 5)} AS macd,
  {r('CASE WHEN rn >= 33 THEN sg.v END', 5)} AS macd_signal, {r('CASE WHEN rn >= 33 THEN line - sg.v END', 5)} AS macd_hist
  FROM nb JOIN ln USING (symbol, rn) JOIN sg USING (symbol, rn)""")
def _(spark, sf):
    return tidy(folds.macd(frames.bars(spark, sf)).select("symbol", "ts", "macd", "macd_signal", "macd_hist"), 5)


@query("w10_atr", f"""WITH {BARS}, t AS (SELECT symbol, ts, close, greatest(high - low, abs(high - lag(close) OVER ({W_})), abs(low - lag(close) OVER ({W_}))) AS tr FROM bars)
  SELECT symbol, ts, {r('tr')} AS tr, {r(roll('avg', 'tr', 14))} AS atr, {r(f"({roll('avg', 'tr', 14)}) / close")} AS atr_ratio FROM t""")
def _(spark, sf):
    return tidy(win.atr(frames.bars(spark, sf)).select("symbol", "ts", "tr", "atr", "atr_ratio"))


@query("w11_momentum", f"""WITH {RET}, m AS (SELECT symbol, ts, {roll('sum', 'ret', 21)} AS m1, {roll('sum', 'ret', 63)} AS m3, {roll('sum', 'ret', 126)} AS m6,
    volume / ({roll('avg', 'volume', 21)}) AS vm FROM rets)
  SELECT symbol, ts, {r('m1')} AS mom_1m, {r('m3')} AS mom_3m, {r('m6')} AS mom_6m, {r('vm')} AS volume_momentum, {r('0.4*m1 + 0.3*m3 + 0.3*m6')} AS momentum_score FROM m""")
def _(spark, sf):
    return tidy(win.momentum(frames.bars(spark, sf)).select("symbol", "ts", "mom_1m", "mom_3m", "mom_6m", "volume_momentum", "momentum_score"))


@query("w12_vol_regime", f"""WITH {RET}, h AS (SELECT symbol, ts, ({roll('stddev_samp', 'ret', 21)}) * sqrt(252) AS hv FROM rets)
  SELECT symbol, ts, {r('hv')} AS hist_vol, {r(f"hv / ({roll('avg', 'hv', 63)})")} AS vol_regime,
  {r(f"(hv - ({roll('avg', 'hv', 63)})) / ({roll('stddev_samp', 'hv', 63)})")} AS vol_z FROM h""")
def _(spark, sf):
    return tidy(win.vol_regime(frames.bars(spark, sf)).select("symbol", "ts", "hist_vol", "vol_regime", "vol_z"))


@query("w13_moments", f"""WITH {RET} SELECT symbol, ts, {r(roll('skewness', 'ret', 63), 5)} AS skew, {r(roll('kurtosis', 'ret', 63), 5)} AS kurt FROM rets""")
def _(spark, sf):
    return tidy(win.rolling_moments(frames.bars(spark, sf)).select("symbol", "ts", "skew", "kurt"), 5)


_lags = " UNION ALL ".join(
    f"SELECT symbol, {k} AS k, stddev_pop(d) AS s FROM (SELECT symbol, close - lag(close, {k}) OVER ({W_}) AS d FROM bars) GROUP BY symbol"
    for k in range(2, 20))


@query("w14_hurst", f"""WITH {BARS}, tau AS ({_lags})
  SELECT symbol, {r('regr_slope(ln(greatest(sqrt(s), 1e-8)), ln(k))')} AS hurst FROM tau GROUP BY symbol""")
def _(spark, sf):
    return tidy(win.hurst(frames.bars(spark, sf)))


@query("w15_roc", f"WITH {BARS} SELECT symbol, ts, {r(f'(close - lag(close, 10) OVER ({W_})) / lag(close, 10) OVER ({W_}) * 100')} AS roc_10 FROM bars")
def _(spark, sf):
    return tidy(win.roc(frames.bars(spark, sf)).select("symbol", "ts", "roc_10"))


@query("w18_volume_ratio", f"WITH {BARS} SELECT symbol, ts, {r('(' + roll('avg', 'volume', 5) + ') / (' + roll('avg', 'volume', 20) + ')')} AS volume_ratio FROM bars")
def _(spark, sf):
    return tidy(win.volume_ratio(frames.bars(spark, sf)).select("symbol", "ts", "volume_ratio"))


@query("w19_recent_range", f"""WITH {BARS} SELECT symbol, ts, {r(f'max(high) OVER ({W_} ROWS 9 PRECEDING)')} AS recent_high,
  {r(f'min(low) OVER ({W_} ROWS 9 PRECEDING)')} AS recent_low FROM bars""")
def _(spark, sf):
    return tidy(win.recent_range(frames.bars(spark, sf)).select("symbol", "ts", "recent_high", "recent_low"))


@query("w21_vol_percentile", f"""WITH {RET} SELECT symbol, ts, {r(roll('stddev_samp', 'ret', 30))} AS roll_vol FROM rets""")
def _(spark, sf):
    return tidy(win.vol_percentile(frames.bars(spark, sf)).select("symbol", "ts", "roll_vol"))


@query("w24_prev_close", f"""WITH {BARS} SELECT symbol, ts, lag(close) OVER ({W_}) AS prev_close,
  {r(f'(close - lag(close) OVER ({W_})) / lag(close) OVER ({W_}) * 100')} AS change_pct FROM bars""")
def _(spark, sf):
    return tidy(win.prev_close(frames.bars(spark, sf)).select("symbol", "ts", "prev_close", "change_pct"))
