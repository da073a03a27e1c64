"""Registered intraday context, strategy signals, outcomes, sweeps and experiment analytics."""

import os

from pyspark.sql import functions as F

from barwright.catalog.aggregates import SESSION, fitness_sql, regime_case, _neg_sortino
from barwright.catalog.indicators import MOVES, roll
from barwright.catalog.registry import he, query, r, tidy
from barwright.catalog.sqlframes import BARS, BARS5, EXPERIMENTS, NEWS, RUNS
from barwright.operators import joins, research, windows as win
from barwright.sources import frames

S_ = "PARTITION BY symbol, session ORDER BY ts"

RUNNING = f"""run AS (SELECT *, count(*) OVER w AS n, first(open) OVER w AS day_open, max(high) OVER w AS day_high, min(low) OVER w AS day_low,
    sum(volume) OVER w AS cumv, sum((high + low + close) / 3 * volume) OVER w AS pv FROM bars5 WINDOW w AS ({S_})),
  run2 AS (SELECT * EXCLUDE (pv), CASE WHEN cumv >= 1 THEN pv / cumv END AS vwap FROM run)"""

CTX = f"""{SESSION}, dctx AS (SELECT symbol, session, lag(close) OVER w AS prev_close,
    CASE WHEN count(volume) OVER b >= 2 THEN avg(volume) OVER b END AS avg20 FROM sess WINDOW w AS (PARTITION BY symbol ORDER BY session), b AS (PARTITION BY symbol ORDER BY session ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"""

MARKET = f"""slots AS (SELECT DISTINCT session, ts FROM bars5),
  an AS (SELECT s.session, s.ts, a.day_open AS ao, a.day_high AS ah, a.day_low AS al, a.close AS ac, b.day_open AS bo, b.close AS bc FROM slots s
    LEFT JOIN run2 a ON a.symbol = 'view' AND a.ts = s.ts AND a.session = s.session LEFT JOIN run2 b ON b.symbol = 'click' AND b.ts = s.ts AND b.session = s.session),
  ff AS (SELECT session, ts, {', '.join(f'last_value({c} IGNORE NULLS) OVER w AS {c}' for c in ('ao', 'ah', 'al', 'ac', 'bo', 'bc'))} FROM an WINDOW w AS (PARTITION BY session ORDER BY ts)),
  mk AS (SELECT session, ts, coalesce((ac - ao) / nullif(ao, 0) * 100, 0) AS spy, coalesce((ah - al) / nullif(ao, 0) * 100, 0) AS rng,
    CASE WHEN ac IS NULL THEN 0 ELSE coalesce((bc - bo) / nullif(bo, 0) * 100, 0) END AS qqq, ac FROM ff),
  market AS (SELECT session, ts, CASE WHEN ac IS NULL THEN 'unknown' ELSE {regime_case('rng', 'spy')} END AS regime, spy, qqq FROM mk)"""


@query("w16_session_running", f"""WITH {BARS5}, {CTX}, {RUNNING} SELECT symbol, session, ts, {r('day_open', 7)} AS day_open, {r('day_high', 7)} AS day_high, {r('day_low', 7)} AS day_low, CAST(cumv AS BIGINT) AS cum_volume, {r('vwap', 7)} AS vwap,
  {r('CASE WHEN vwap > 0 THEN (close - vwap) / vwap * 100 END', 4)} AS price_vs_vwap_pct, {r('CASE WHEN avg20 > 0 THEN cumv / avg20 END', 4)} AS cum_volume_ratio
  FROM run2 LEFT JOIN dctx USING (symbol, session)""")
def _(spark, sf):
    from barwright.operators.aggs import session_summary
    b = frames.bars5(spark, sf)
    d = joins.daily_context(session_summary(b).select("symbol", F.col("session").alias("ts"), "close", "volume"))
    b = b.join(d.select("symbol", F.col("ts").alias("session"), "avg_volume_20d"), ["symbol", "session"], "left")
    b = win.session_running(b, "avg_volume_20d")
    b = b.withColumns({"price_vs_vwap_pct": F.round("price_vs_vwap_pct", 4), "cum_volume_ratio": F.round("cum_volume_ratio", 4)})
    return tidy(b.select(
        "symbol", "session", "ts", "day_open", "day_high", "day_low", "cum_volume", "vwap", "price_vs_vwap_pct", "cum_volume_ratio"), 7)


@query("w17_running_regime", f"WITH {BARS5}, {RUNNING}, {MARKET} SELECT session, ts, regime, {r('spy')} AS spy_change_pct, {r('qqq')} AS qqq_change_pct FROM market")
def _(spark, sf):
    return tidy(joins.running_regime(frames.bars5(spark, sf), *frames.anchors()))


@query("j03_daily_context", f"""WITH {BARS} SELECT symbol, ts, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS prev_close,
  {r('CASE WHEN count(volume) OVER b >= 2 THEN avg(volume) OVER b END')} AS avg_volume_20d FROM bars WINDOW b AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
def _(spark, sf):
    return tidy(joins.daily_context(frames.bars(spark, sf)).select("symbol", "ts", "prev_close", "avg_volume_20d"))


@query("j08_market_context", f"""WITH {BARS5}, {RUNNING}, {MARKET} SELECT symbol, ts, {r('close')} AS close, regime, {r('spy')} AS spy_change_pct, {r('qqq')} AS qqq_change_pct
  FROM bars5 JOIN market USING (session, ts) WHERE symbol NOT IN ('view', 'click')""")
def _(spark, sf):
    return tidy(joins.with_market_context(frames.bars5(spark, sf), *frames.anchors()).select("symbol", "ts", "close", "regime", "spy_change_pct", "qqq_change_pct"))


@query("p05_session_flags", f"""WITH {BARS5} SELECT symbol, ts, session, et_minute, et_minute >= 575 AND et_minute < 945 AS tradeable, et_minute >= 945 AS flatten FROM bars5""")
def _(spark, sf):
    return tidy(research.with_session_flags(frames.bars5(spark, sf)).select("symbol", "ts", "session", "et_minute", "tradeable", "flatten"))


# -- signals ----------------------------------------------------------------------------

# the published parameters, with thresholds scaled to the test prices' range
P = {**research.DAY, "min_confidence": 40.0, "vwap_near_band_pct": 0.25}


def session_ema(x, n):
    """EMA over the session so far, folding the (at most day-long) list of values."""
    k = f"(CAST(2 AS DOUBLE)/{n + 1})"
    return f"list_reduce(list({x}) OVER ({S_}), lambda a, y: y * {k} + a * (1 - {k}))"


def _rsi10():
    def over(x):
        w = f"OVER ({S_} ROWS 9 PRECEDING)"
        return f"CASE WHEN count({x}) {w} = 10 THEN avg({x}) {w} END"
    return f"""mvs AS (SELECT symbol, session, ts, close - lag(close) OVER ({S_}) AS mv FROM run2 WHERE symbol NOT IN ('view', 'click')),
      uds AS (SELECT *, CASE WHEN mv IS NOT NULL THEN greatest(mv, 0) END AS u, CASE WHEN mv IS NOT NULL THEN greatest(-mv, 0) END AS d FROM mvs),
      gl AS (SELECT symbol, session, ts, {over('u')} AS g, {over('d')} AS l FROM uds),
      rsis AS (SELECT symbol, session, ts, CASE WHEN g IS NULL THEN NULL WHEN l <= 1e-10 THEN 100 ELSE {he('100 - 100 / (1 + g / l)', 2)} END AS rsi FROM gl)"""


FEAT = f"""{BARS5}, {CTX}, {RUNNING}, {MARKET}, {_rsi10()}, ln AS (SELECT symbol, session, ts, n, {session_ema('close', 12)} - {session_ema('close', 26)} AS line FROM run2 WHERE symbol NOT IN ('view', 'click')),
  sg AS (SELECT symbol, session, n, line, {session_ema('line', 7)} AS v FROM ln),
  feat AS (SELECT b.symbol, b.session, b.ts, b.close, day_low, day_high, b.n, regime, spy, qqq, rsi, CASE WHEN vwap > 0 THEN (b.close - vwap) / vwap * 100 END AS dev,
      CASE WHEN avg20 > 0 THEN cumv / avg20 END AS vol, CASE WHEN b.n >= 33 THEN line END AS macd, CASE WHEN b.n >= 33 THEN line - sg.v END AS hist
    FROM run2 b JOIN market USING (session, ts) LEFT JOIN dctx USING (symbol, session) JOIN rsis USING (symbol, session, ts)
    JOIN sg USING (symbol, session, n) WHERE b.n >= 5 AND et_minute >= 575 AND et_minute < 945)"""


def day_sql(v, source="feat", out="sig", p=P):
    """The day strategy as SQL over the feature rows; ``v`` is a prefix for the generated tables."""
    tier = (f"CASE WHEN rsi < {p['rsi_oversold']} THEN 100 WHEN rsi < {p['rsi_very_oversold']} THEN 90 WHEN rsi < {p['rsi_strong_oversold']} THEN 80 "
            f"WHEN rsi < {p['rsi_moderate_oversold']} THEN 70 WHEN rsi > {p['rsi_overbought']} THEN -100 WHEN rsi < {p['rsi_neutral_low']} THEN 60 "
            f"WHEN rsi > {p['rsi_neutral_high']} THEN -60 ELSE 0 END")
    vs = f"CASE WHEN vol >= {p['volume_strong_ratio']} THEN 100 WHEN vol >= {p['volume_confirm_ratio']} THEN 70 WHEN vol >= 0.8 THEN 40 WHEN vol IS NOT NULL THEN 10 ELSE 0 END"
    near, d = p["vwap_near_band_pct"], "::DOUBLE"
    step = [f"""{v}0 AS (SELECT *, greatest({tier}, 0) * {p['weight_rsi']}{d} + CASE WHEN dev > {near} THEN {p['weight_vwap']}{d} * least(100, 60 + abs(dev) * 10) ELSE 0 END AS bull,
        greatest(-({tier}), 0) * {p['weight_rsi']}{d} + CASE WHEN dev < -{near} THEN {p['weight_vwap']}{d} * least(100, 60 + abs(dev) * 10) ELSE 0 END AS bear FROM {source})""",
            f"""{v}1 AS (SELECT * REPLACE (bull + CASE WHEN bull >= bear THEN {p['weight_volume']}{d} * {vs} ELSE 0 END + CASE WHEN hist > 0 AND macd > 0 THEN {p['weight_macd']}{d} * 80 ELSE 0 END AS bull,
        bear + CASE WHEN bull < bear THEN {p['weight_volume']}{d} * {vs} ELSE 0 END + CASE WHEN hist < 0 AND macd < 0 THEN {p['weight_macd']}{d} * 80 ELSE 0 END AS bear) FROM {v}0)""",
            f"""{v}2 AS (SELECT * REPLACE (bull * CASE WHEN regime = 'trending_up' AND bull > bear THEN 1.1{d} WHEN regime = 'range_bound' AND rsi < {p['rsi_moderate_oversold']} THEN 1.15{d} ELSE 1 END AS bull,
        bear * CASE WHEN regime = 'trending_down' AND bear > bull THEN 1.1{d} WHEN regime = 'range_bound' AND rsi > {p['rsi_overbought']} THEN 1.15{d} ELSE 1 END AS bear) FROM {v}1)"""]
    for i, c in ((3, "spy"), (4, "qqq")):
        step.append(f"""{v}{i} AS (SELECT * REPLACE (bull * CASE WHEN {c} > 0.4 AND bull > bear THEN 1.05{d} ELSE 1 END AS bull, bear * CASE WHEN {c} < -0.4 AND bear > bull THEN 1.05{d} ELSE 1 END AS bear) FROM {v}{i - 1})""")
    step.append(f"""{v}5 AS (SELECT *, least(greatest(bull, bear) * CASE regime WHEN 'volatile' THEN 0.65{d} WHEN 'unknown' THEN 0.70{d} ELSE 1 END, 95) AS confidence,
        CASE WHEN bull > bear THEN 'long' WHEN bear > bull THEN 'short' END AS direction FROM {v}4)""")
    step.append(levels(f"{v}5", v + "l", out, p["min_confidence"], p["stop_pct"], p["target_multiplier"], "day_low", "day_high", 0.999, 1.001))
    return ", ".join(step)


def levels(source, v, out, min_conf, stop, mult, low, high, lf, hf):
    d = "::DOUBLE"
    return f"""{v}a AS (SELECT *, close AS entry_price, direction = 'long' AS lg, {he(f"close * CASE WHEN direction = 'long' THEN 1.0{d} - {stop}{d} ELSE 1.0{d} + {stop}{d} END", 4)} AS dflt,
        {he(f"CASE WHEN direction = 'long' THEN {low} * {lf}{d} ELSE {high} * {hf}{d} END", 4)} AS nat FROM {source} WHERE direction IS NOT NULL AND confidence >= {min_conf}),
      {v}b AS (SELECT *, CASE WHEN lg THEN greatest(dflt, nat) ELSE least(dflt, nat) END AS tight FROM {v}a),
      {v}c AS (SELECT *, CASE WHEN CASE WHEN lg THEN entry_price - tight ELSE tight - entry_price END <= 0 THEN dflt ELSE tight END AS stop_price FROM {v}b),
      {v}d AS (SELECT *, {he(f"CASE WHEN lg THEN entry_price + (entry_price - stop_price) * {mult}{d} ELSE entry_price - (stop_price - entry_price) * {mult}{d} END", 4)} AS target_price FROM {v}c),
      {out} AS (SELECT * FROM {v}d WHERE CASE WHEN lg THEN target_price > entry_price ELSE target_price < entry_price END)"""


research.STRATEGIES["scaled_day"] = lambda features: research.day_signals(features, P)
SIGCOLS = f"direction, {r('confidence', 4)} AS confidence, {r('entry_price')} AS entry_price, stop_price, target_price"


def day_feats(spark, sf):
    return research.day_features(frames.bars5(spark, sf), *frames.anchors())


def sig4(df, digits=4):
    df = df.withColumn("confidence", F.round("confidence", digits))
    return df.withColumn("entry_price", F.round("entry_price", 6)) if "entry_price" in df.columns else df


@query("w25_day_signals", f"WITH {FEAT}, {day_sql('v')} SELECT symbol, session, ts, {SIGCOLS} FROM sig")
def _(spark, sf):
    return sig4(research.day_signals(day_feats(spark, sf), P))


# the published parameters as they are; what stays below the published threshold is shown and marked
PUBLISHED = {**research.DAY, "min_confidence": 20.0}


@query("w25_published_parameters", f"WITH {FEAT}, {day_sql('v', p=PUBLISHED)} SELECT symbol, session, ts, {SIGCOLS.replace(r('confidence', 4), r('confidence', 6))}, round(confidence, 6) >= {research.DAY['min_confidence']} AS passes FROM sig")
def _(spark, sf):
    s = sig4(research.day_signals(day_feats(spark, sf), PUBLISHED), 6)
    return s.withColumn("passes", F.col("confidence") >= research.DAY["min_confidence"])


def reversal(pdf):
    """A strategy in Python: a session whose close falls for three bars in a row is bought at the next higher close."""
    p = pdf.assign(falls=(pdf["close"].diff() < 0).rolling(3).sum().shift(1), up=pdf["close"].diff() > 0)
    p = p[(p["falls"] == 3) & p["up"]]
    return p.assign(direction="long", confidence=50.0, entry_price=p["close"], stop_price=p["close"] * 0.99, target_price=p["close"] * 1.02)[
        ["symbol", "session", "ts", "direction", "confidence", "entry_price", "stop_price", "target_price"]]


@query("x01_python_strategy", f"""WITH {BARS5}, d_ AS (SELECT *, close - lag(close) OVER w AS d FROM bars5 WINDOW w AS (PARTITION BY symbol, session ORDER BY ts)),
  f_ AS (SELECT *, lag(d, 1) OVER w < 0 AND lag(d, 2) OVER w < 0 AND lag(d, 3) OVER w < 0 AS fell FROM d_ WINDOW w AS (PARTITION BY symbol, session ORDER BY ts))
  SELECT symbol, session, ts, 'long' AS direction, {r('close')} AS entry_price, {r('close * 0.99::DOUBLE')} AS stop_price, {r('close * 1.02::DOUBLE')} AS target_price FROM f_ WHERE fell AND d > 0""")
def _(spark, sf):
    run = research.python_strategy(reversal)
    return tidy(run(frames.bars5(spark, sf)).select("symbol", "session", "ts", "direction", "entry_price", "stop_price", "target_price"))


FALLS = f"""WITH {BARS5}, d_ AS (SELECT *, close - lag(close) OVER w AS d FROM bars5 WINDOW w AS (PARTITION BY symbol, session ORDER BY ts)),
  f_ AS (SELECT *, lag(d, 1) OVER w < 0 AND lag(d, 2) OVER w < 0 AND lag(d, 3) OVER w < 0 AS fell FROM d_ WINDOW w AS (PARTITION BY symbol, session ORDER BY ts))
  SELECT symbol, session, ts, 'long' AS direction, 60.0::DOUBLE AS confidence, {r('close')} AS entry_price, {r('close * (1 - 0.02::DOUBLE)')} AS stop_price, {r('close * (1 + 0.03::DOUBLE)')} AS target_price FROM f_ WHERE fell AND d > 0"""
THREE_FALLS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "strategies", "three_falls.py")
FALL_CONTEXT = {"confidence": 60.0, "stop_pct": 0.02, "target_pct": 0.03}


@query("x01_strategy_file", FALLS)
def _(spark, sf):
    """A strategy whose code lives in a file that is loaded at run time."""
    return tidy(research.load_strategy(spark, THREE_FALLS, FALL_CONTEXT)(frames.bars5(spark, sf)))


@query("x01_strategy_sql", FALLS)
def _(spark, sf):
    """The same strategy as a table function in SQL."""
    run = research.load_strategy(spark, THREE_FALLS, FALL_CONTEXT)
    research.register_table_function(spark, "three_falls", run.generate, run.origin)
    bars = frames.bars5(spark, sf).select("symbol", "session", "ts", "close")
    return tidy(spark.sql("SELECT * FROM three_falls(TABLE({bars}) PARTITION BY (symbol, session) ORDER BY ts)", bars=bars))


@query("x01_strategy_registry", f"WITH {FEAT}, {day_sql('v')} SELECT session, direction, count(*) AS signals, {r('avg(confidence)', 4)} AS confidence FROM sig GROUP BY 1, 2")
def _(spark, sf):
    s = research.run_strategy("scaled_day", day_feats(spark, sf))
    return tidy(s.groupBy("session", "direction").agg(F.count(F.lit(1)).alias("signals"), F.avg("confidence").alias("confidence")), 4)


Q = research.SWING
_d = "::DOUBLE"
_tier = f"CASE WHEN rsi < {Q['rsi_oversold']} THEN 90 WHEN rsi > {Q['rsi_overbought']} THEN -90 WHEN rsi < 45 THEN 50 WHEN rsi > 55 THEN -50 ELSE 0 END"
SWINGSQL = f"""{MOVES}, gl AS (SELECT symbol, ts, {roll('avg', 'u1', 14)} AS g, {roll('avg', 'd1', 14)} AS l FROM ud),
  rsis AS (SELECT symbol, ts, CASE WHEN g IS NULL THEN NULL WHEN l <= 1e-10 THEN 100 ELSE {he('100 - 100 / (1 + g / l)', 2)} END AS rsi FROM gl),
  f0 AS (SELECT *, {roll('avg', 'close', 20)} AS fast, {roll('avg', 'close', 50)} AS slow, (close - lag(close, 10) OVER w) / lag(close, 10) OVER w * 100 AS roc,
    ({roll('avg', 'volume', 5)}) / ({roll('avg', 'volume', 20)}) AS vr, max(high) OVER (PARTITION BY symbol ORDER BY ts ROWS 9 PRECEDING) AS rhi,
    min(low) OVER (PARTITION BY symbol ORDER BY ts ROWS 9 PRECEDING) AS rlo, row_number() OVER w AS n FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
  f1 AS (SELECT *, (fast - slow) / slow * 100 AS sp, (close - fast) / fast * 100 AS off FROM f0 JOIN rsis USING (symbol, ts) WHERE n >= 55),
  f2 AS (SELECT *, CASE WHEN sp > 0.5 THEN least(100, 50 + abs(sp) * 15) * 0.35{_d} ELSE 0 END + greatest({_tier}, 0) * 0.25{_d} + CASE WHEN roc > 2 THEN least(100, 40 + abs(roc) * 8) * 0.25{_d} ELSE 0 END AS bull,
    CASE WHEN sp < -0.5 THEN least(100, 50 + abs(sp) * 15) * 0.35{_d} ELSE 0 END + greatest(-({_tier}), 0) * 0.25{_d} + CASE WHEN roc < -2 THEN least(100, 40 + abs(roc) * 8) * 0.25{_d} ELSE 0 END AS bear FROM f1),
  f3 AS (SELECT *, CASE WHEN vr IS NULL THEN 0 WHEN vr >= 1.2 THEN least(100, 50 + (vr - 1) * 40) ELSE 30 END * 0.15{_d} AS vs FROM f2),
  f4 AS (SELECT * REPLACE (bull + CASE WHEN bull >= bear THEN vs ELSE 0 END AS bull, bear + CASE WHEN bull < bear THEN vs ELSE 0 END AS bear) FROM f3),
  f5 AS (SELECT * REPLACE (bull * CASE WHEN sp > 0.5 AND off > -1.5 AND off < 0.5 THEN 1.15{_d} ELSE 1 END AS bull, bear * CASE WHEN sp < -0.5 AND off > -0.5 AND off < 1.5 THEN 1.15{_d} ELSE 1 END AS bear) FROM f4),
  f6 AS (SELECT *, least(greatest(bull, bear), 95) AS confidence, CASE WHEN bull > bear THEN 'long' WHEN bear > bull THEN 'short' END AS direction FROM f5),
  {levels('f6', 'z', 'sig', 50, 0.03, 2.5, 'rlo', 'rhi', 0.995, 1.005)}"""


@query("w26_swing_signals", f"WITH {SWINGSQL} SELECT symbol, ts, {SIGCOLS} FROM sig")
def _(spark, sf):
    return sig4(research.swing_signals(frames.bars(spark, sf)))


@query("f04_bracket_levels", f"""WITH {BARS}, b0 AS (SELECT symbol, ts, close, low, high, CASE WHEN volume % 2 = 0 THEN 'long' ELSE 'short' END AS direction, 100 AS confidence FROM bars),
  {levels('b0', 'z', 'sig', 0, 0.01, 3.3, 'low', 'high', 0.999, 1.001)} SELECT symbol, ts, direction, stop_price, target_price FROM zd""")
def _(spark, sf):
    b = frames.bars(spark, sf).withColumn("direction", F.when(F.col("volume") % 2 == 0, "long").otherwise("short")).withColumn("entry_price", F.col("close"))
    return research.bracket_levels(b, F.lit(0.01), F.lit(3.3), "low", "high").select("symbol", "ts", "direction", "stop_price", "target_price")


def outcome_sql(sig="sig", out="outc"):
    e, x = f"CASE WHEN lg THEN 1.0{_d} + 0.0005{_d} ELSE 1.0{_d} - 0.0005{_d} END", f"CASE WHEN lg THEN 1.0{_d} - 0.0005{_d} ELSE 1.0{_d} + 0.0005{_d} END"
    st = "CASE WHEN lg THEN b.low <= stop_price ELSE b.high >= stop_price END"
    tg = "CASE WHEN lg THEN b.high >= target_price ELSE b.low <= target_price END"
    return f"""{out}0 AS (SELECT s.*, (SELECT arg_min({{'t': b.ts, 'o': b.open, 'c': b.close, 'f': b.et_minute >= 945, 's': {st}}}, b.ts) FROM bars5 b
        WHERE b.symbol = s.symbol AND b.session = s.session AND b.ts > s.ts AND (b.et_minute >= 945 OR {st} OR {tg})) AS h, l.close AS lc, l.lts FROM {sig} s
        JOIN (SELECT symbol, session, arg_max(close, ts) AS close, max(ts) AS lts FROM bars5 GROUP BY 1, 2) l USING (symbol, session)),
      {out}1 AS (SELECT *, CASE WHEN h IS NULL THEN 'eod' WHEN h.f THEN 'flatten' WHEN h.s THEN 'stop' ELSE 'target' END AS exit_reason FROM {out}0),
      {out}2 AS (SELECT *, {he(f'entry_price * {e}', 4)} AS entry_fill, {he(f'''CASE exit_reason WHEN 'eod' THEN lc WHEN 'flatten' THEN h.c
        WHEN 'stop' THEN CASE WHEN lg THEN least(stop_price, h.o) ELSE greatest(stop_price, h.o) END ELSE CASE WHEN lg THEN greatest(target_price, h.o) ELSE least(target_price, h.o) END END * {x}''', 4)} AS exit_fill,
        coalesce(h.t, lts) AS exit_ts FROM {out}1),
      {out} AS (SELECT *, CASE WHEN lg THEN exit_fill - entry_fill ELSE entry_fill - exit_fill END / entry_fill * 100 AS pnl_pct FROM {out}2)"""


@query("j09_label_brackets", f"""WITH {FEAT}, {day_sql('v')}, {outcome_sql()} SELECT symbol, session, ts, direction, exit_reason, exit_ts, entry_fill, exit_fill, {r('pnl_pct', 4)} AS pnl_pct FROM outc""")
def _(spark, sf):
    b = frames.bars5(spark, sf)
    t = research.label_brackets(research.day_signals(research.day_features(b, *frames.anchors(), P), P), b)
    return t.select("symbol", "session", "ts", "direction", "exit_reason", "exit_ts", "entry_fill", "exit_fill", F.round("pnl_pct", 4).alias("pnl_pct"))


@query("f03_fill_price", f"""SELECT event_id, {he(f"value * CASE WHEN event_id % 2 = 0 THEN 1.0{_d} + 0.0005{_d} ELSE 1.0{_d} - 0.0005{_d} END", 4)} AS entry_fill,
  {he(f"value * CASE WHEN event_id % 2 = 0 THEN 1.0{_d} - 0.0005{_d} ELSE 1.0{_d} + 0.0005{_d} END", 4)} AS exit_fill FROM events""")
def _(spark, sf):
    from barwright.functions.numeric import fill_price
    e = frames.table(spark, sf, "events").withColumn("d", F.when(F.col("event_id") % 2 == 0, "long").otherwise("short"))
    return e.select("event_id", fill_price("value", "d", "entry").alias("entry_fill"), fill_price("value", "d", "exit").alias("exit_fill"))


@query("t02_top_signals", f"""WITH {FEAT}, {day_sql('v')}, k AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY confidence DESC, symbol) AS rn FROM sig)
  SELECT ts, symbol, {r('confidence', 4)} AS confidence FROM k WHERE rn <= 2""")
def _(spark, sf):
    return sig4(research.top_signals_per_bar(research.day_signals(day_feats(spark, sf), P), 2).select("ts", "symbol", "confidence"))


@query("t05_best_signal", f"""WITH {FEAT}, {day_sql('v')}, k AS (SELECT symbol, arg_max(direction, (confidence, -epoch_us(ts))) AS direction, max(confidence) AS confidence FROM sig GROUP BY 1)
  SELECT symbol, CASE direction WHEN 'long' THEN 'bullish' WHEN 'short' THEN 'bearish' ELSE 'neutral' END AS signal, {r('coalesce(confidence, 0)', 4)} AS confidence
  FROM (SELECT DISTINCT event_type AS symbol FROM events) LEFT JOIN k USING (symbol)""")
def _(spark, sf):
    u = frames.table(spark, sf, "events").select(F.col("event_type").alias("symbol")).distinct()
    return sig4(research.best_signal(research.day_signals(day_feats(spark, sf), P), u))


GRID = {
    "base": {},
    "wide_vwap": {"vwap_near_band_pct": 0.40},
    "tight_stop": {"stop_pct": 0.006, "target_multiplier": 2.0},
    "strict": {"min_confidence": 50.0},
    "oversold": {"rsi_oversold": 30.0, "rsi_moderate_oversold": 42.0},
    "volume": {"volume_confirm_ratio": 1.1, "volume_strong_ratio": 1.8},
}
_variants = [(n, {**P, **o}) for n, o in GRID.items()]
SWEEP = f"""{FEAT}, {', '.join(day_sql(f'v{i}_', out=f'sig{i}', p=p) for i, (n, p) in enumerate(_variants))},
  allsig AS ({' UNION ALL BY NAME '.join(f"SELECT '{n}' AS variant, symbol, session, ts, lg, direction, confidence, entry_price, stop_price, target_price FROM sig{i}" for i, (n, p) in enumerate(_variants))}),
  topsig AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY variant, ts ORDER BY confidence DESC, symbol) AS rk FROM allsig) WHERE rk <= 5),
  {outcome_sql('topsig')}, tr AS (SELECT *, CASE WHEN lg THEN exit_fill - entry_fill ELSE entry_fill - exit_fill END * greatest(1, floor(15000 / entry_fill)) AS pnl FROM outc),
  dd_ AS (SELECT variant, session, sum(pnl) AS pnl FROM tr GROUP BY 1, 2),
  cv AS (SELECT variant, session AS date, 100000 + sum(pnl) OVER (PARTITION BY variant ORDER BY session) AS value FROM dd_
    UNION ALL SELECT variant, min(session) - 1, 100000 FROM dd_ GROUP BY 1),
  x_ AS (SELECT *, value / lag(value) OVER w - 1 - 0.0434{_d} / 252 AS ex, max(value) OVER w AS peak FROM cv WINDOW w AS (PARTITION BY variant ORDER BY date)),
  m_ AS (SELECT variant, CASE WHEN count(ex) >= 1 THEN CASE WHEN stddev_samp(ex) > 1e-12 THEN avg(ex) / stddev_samp(ex) * sqrt(252) ELSE 0 END END AS sharpe,
    least({_neg_sortino(20)}, 20) AS sortino, min((value - peak) / peak) * 100 AS mdd, (arg_max(value, date) - 100000) / 100000 * 100 AS total_return_pct FROM x_ GROUP BY 1),
  t_ AS (SELECT variant, count(*) AS num_trades, count(*) FILTER (pnl > 0) / count(*) AS win_rate, coalesce(sum(pnl) FILTER (pnl > 0), 0) AS gp, abs(sum(pnl) FILTER (pnl <= 0)) AS gl FROM tr GROUP BY 1),
  fit AS (SELECT variant, num_trades, win_rate, total_return_pct, mdd, {fitness_sql('day')} AS fitness FROM m_ JOIN t_ USING (variant))"""


@query("x02_parameter_sweep", f"""WITH {SWEEP} SELECT variant, num_trades, {r('win_rate', 4)} AS win_rate, {r('total_return_pct', 4)} AS total_return_pct,
  {r('mdd', 4)} AS max_drawdown, {r('fitness', 4)} AS fitness FROM fit""")
def _(spark, sf):
    s = research.sweep(frames.bars5(spark, sf), GRID, *frames.anchors(), base=P)
    return tidy(s.select("variant", "num_trades", "win_rate", "total_return_pct", "max_drawdown", "fitness"), 4)


SIDES = SWEEP.replace("tr AS (SELECT *, ", """cut_ AS (SELECT min(session) AS cut FROM (SELECT DISTINCT session FROM bars5 ORDER BY 1 DESC LIMIT 20)),
  tr AS (SELECT * REPLACE (variant || CASE WHEN session >= (SELECT cut FROM cut_) THEN '/out' ELSE '/in' END AS variant), """)


@query("x02_keep_rule", f"""WITH {SIDES}, j_ AS (SELECT split_part(variant, '/', 1) AS v, max(fitness) FILTER (variant LIKE '%/in') AS i, max(fitness) FILTER (variant LIKE '%/out') AS o FROM fit GROUP BY 1),
  b_ AS (SELECT v, i, o FROM j_ WHERE i IS NOT NULL ORDER BY i DESC, v DESC LIMIT 1)
  SELECT v AS variant, {r('i', 4)} AS is_fitness, {r('o', 4)} AS oos_fitness, coalesce(o, -999) >= -5 AS kept FROM b_""")
def _(spark, sf):
    return tidy(research.keep_rule(research.sweep(frames.bars5(spark, sf), GRID, *frames.anchors(), base=P, out_of_sample=20)), 4)


# -- calendars and as-of ----------------------------------------------------------------

@query("p04_business_days", """SELECT c_mktsegment AS symbol, unnest(range(min(o_orderdate)::DATE::TIMESTAMP, max(o_orderdate)::DATE::TIMESTAMP + INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS date
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""".join(["SELECT symbol, date FROM (", ") WHERE isodow(date) < 6"]))
def _(spark, sf):
    span = frames.bars(spark, sf).groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return joins.business_days(span, F.col("a"), F.col("b")).select("symbol", "date")


@query("p04_last_business_days", f"""WITH {BARS}, e AS (SELECT symbol, max(ts) AS d FROM bars GROUP BY 1), c AS (SELECT symbol, CAST(d - CAST(i AS INTEGER) AS DATE) AS date FROM e, range(60) t(i)),
  k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM c WHERE isodow(date) < 6) SELECT symbol, date FROM k WHERE rn <= 20""")
def _(spark, sf):
    e = frames.bars(spark, sf).groupBy("symbol").agg(F.max("ts").alias("end"))
    return joins.last_business_days(e, "end", 20).select("symbol", "date")


@query("j01_price_asof_day", f"""WITH {BARS}, d AS (SELECT DISTINCT ts AS date FROM bars WHERE isodow(ts) < 6),
  px AS (SELECT date, symbol, arg_max(close, ts) AS price FROM d JOIN bars ON ts BETWEEN date - 1 AND date GROUP BY 1, 2)
  SELECT date, symbol, price FROM px WHERE date IN (SELECT date FROM px GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT symbol) FROM bars))""")
def _(spark, sf):
    b = frames.bars(spark, sf)
    d = b.select(F.col("ts").alias("date")).distinct().filter(~F.dayofweek("date").isin(1, 7))
    return joins.price_asof_day(d, b).select("date", "symbol", "price")


@query("j14_intraday_context", f"""WITH {BARS5}, {CTX}, {NEWS}, pre AS (SELECT symbol, session, max(high) AS premarket_high, min(low) AS premarket_low, CAST(sum(volume) AS BIGINT) AS premarket_volume
    FROM bars5 WHERE et_minute >= 240 AND et_minute < 570 GROUP BY 1, 2),
  tl AS (SELECT symbol, session, string_agg(CAST(CAST(round(close * 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY ts) AS last_closes FROM (SELECT *, row_number() OVER (PARTITION BY symbol, session ORDER BY ts DESC) AS rn FROM bars5) WHERE rn <= 6 GROUP BY 1, 2),
  hd AS (SELECT symbol, count(*) AS n, sum(length(title)) AS len FROM (SELECT symbol, title, row_number() OVER (PARTITION BY symbol ORDER BY doc_id) AS rn FROM (SELECT * REPLACE (et[CAST(regexp_extract(symbol, '(\\d+)', 1) AS INT) % len(et) + 1] AS symbol)
    FROM news, (SELECT list_sort(list(DISTINCT event_type)) AS et FROM events))) WHERE rn <= 3 GROUP BY 1)
  SELECT symbol, session, {r('close')} AS close, {r('vwap')} AS vwap, {r('premarket_high')} AS premarket_high, {r('premarket_low')} AS premarket_low, premarket_volume, {r('prev_close')} AS prev_close, {r('avg20')} AS avg_volume_20d, last_closes, n AS headlines, CAST(len AS BIGINT) AS headline_chars,
  {r('(close - prev_close) / prev_close * 100')} AS change_1d_pct, {r('volume / avg20')} AS volume_ratio, upper(symbol) AS label
  FROM sess LEFT JOIN pre USING (symbol, session) LEFT JOIN dctx USING (symbol, session) LEFT JOIN tl USING (symbol, session) LEFT JOIN hd USING (symbol)""")
def _(spark, sf):
    b = frames.bars5(spark, sf)
    n = frames.event_news(spark, sf)
    labels = frames.table(spark, sf, "events").select(F.col("event_type").alias("symbol")).distinct().withColumn("label", F.upper("symbol"))
    c = joins.intraday_context(b, n, labels)
    return tidy(c.select("symbol", "session", "close", "vwap", "premarket_high", "premarket_low", "premarket_volume", "prev_close", "avg_volume_20d",
                         F.array_join(F.transform("last_closes", lambda x: F.round(x * 1000).cast("long").cast("string")), ",").alias("last_closes"), F.when(F.col("headlines").isNotNull(), F.size("headlines")).alias("headlines"),
                         F.aggregate("headlines", F.lit(0), lambda a, t: a + F.length(t)).alias("headline_chars"), "change_1d_pct", "volume_ratio", "label"))


# -- experiments ------------------------------------------------------------------------

@query("a37_run_history", f"""WITH {RUNS} SELECT run_id, mode, total_experiments, keep_count, CAST(floor(keep_count / total_experiments * 100) AS BIGINT) AS keep_pct,
  {r('improvement')} AS improvement, {r('best_fitness - lag(best_fitness) OVER (PARTITION BY mode ORDER BY started)')} AS delta_best FROM runs""")
def _(spark, sf):
    return tidy(research.run_history(frames.runs(spark, sf)).select("run_id", "mode", "total_experiments", "keep_count", "keep_pct", "improvement", "delta_best"))


@query("a37_fitness_trajectory", f"""WITH {RUNS}, d AS (SELECT *, best_fitness - lag(best_fitness) OVER (PARTITION BY mode ORDER BY started) AS db FROM runs)
  SELECT mode, count(*) AS runs, {r('arg_min(best_fitness, started)')} AS first_best, {r('arg_max(best_fitness, started)')} AS last_best, {r('avg(db)')} AS avg_delta, {r('min(improvement)')} AS min_improvement,
  {r('max(improvement)')} AS max_improvement, {r('avg(improvement)')} AS avg_improvement, {r('min(baseline_fitness)')} AS min_baseline, {r('max(baseline_fitness)')} AS max_baseline FROM d GROUP BY 1""")
def _(spark, sf):
    return tidy(research.fitness_trajectory(frames.runs(spark, sf)))


@query("a38_best_kept", f"""WITH {EXPERIMENTS} SELECT mode, count(*) AS kept, arg_max(experiment_id, (fitness_score, -experiment_id)) AS experiment_id,
  arg_max(run_id, (fitness_score, -experiment_id)) AS run_id, {r('max(fitness_score)')} AS fitness_score FROM experiments WHERE kept GROUP BY 1""")
def _(spark, sf):
    return tidy(research.best_kept(frames.experiments(spark, sf)))


@query("a38_diminishing_returns", f"""WITH {RUNS}, k AS (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY started DESC) AS rn FROM runs)
  SELECT mode, bool_and(improvement < 0.5) AND count(*) >= 3 AS diminishing, {r('max(improvement)')} AS max_improvement FROM k WHERE rn <= 3 GROUP BY 1""")
def _(spark, sf):
    return tidy(research.diminishing_returns(frames.runs(spark, sf)))


@query("a39_hypothesis_frequency", f"""WITH {EXPERIMENTS}, b AS (SELECT kept, CASE {' '.join('WHEN ' + ' OR '.join(f"contains(lower(hypothesis), '{w}')" for w in ws) + f" THEN '{n}'" for n, ws in research.BUCKETS)} ELSE '(other)' END AS bucket
    FROM experiments WHERE lower(hypothesis) NOT IN ('', 'unknown', 'agent_error', 'syntax_error')) SELECT bucket, count(*) AS tried, count(*) FILTER (kept) AS kept FROM b GROUP BY 1""")
def _(spark, sf):
    return tidy(research.hypothesis_frequency(frames.experiments(spark, sf)))


@query("f09_sparkline", f"""WITH {RUNS}, e AS (SELECT mode, min(best_fitness) AS lo, max(best_fitness) AS hi FROM runs GROUP BY 1)
  SELECT mode, string_agg(CASE WHEN hi = lo THEN '▅' ELSE substr('▁▂▃▄▅▆▇█', CAST(floor((best_fitness - lo) / (hi - lo) * 7) AS INT) + 1, 1) END, '' ORDER BY started) AS sparkline FROM runs JOIN e USING (mode) GROUP BY 1""")
def _(spark, sf):
    return research.sparkline(frames.runs(spark, sf), ("mode",), "started", "best_fitness")
