"""Strategy signals, bracket outcomes, parameter sweeps and experiment analytics."""

import hashlib
import os
import sys
import types
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Window as W, functions as F

from barwright.functions.numeric import fill_price, safe_div, trade_pnl
from barwright.operators import aggs, folds, joins, windows as win

# The day and swing strategies' published parameters.
DAY = {
    "rsi_period": 10, "rsi_oversold": 25.0, "rsi_very_oversold": 28.0, "rsi_strong_oversold": 31.0, "rsi_moderate_oversold": 38.0,
    "rsi_overbought": 63.0, "rsi_neutral_low": 48.0, "rsi_neutral_high": 53.0, "vwap_near_band_pct": 0.85,
    "volume_confirm_ratio": 1.40, "volume_strong_ratio": 2.50, "stop_pct": 0.010, "target_multiplier": 3.3,
    "min_confidence": 59.0, "weight_rsi": 0.35, "weight_vwap": 0.30, "weight_volume": 0.20, "weight_macd": 0.15,
    "macd_fast": 12, "macd_slow": 26, "macd_signal": 7, "volatile_multiplier": 0.65, "unknown_multiplier": 0.70,
}
SWING = {
    "sma_fast": 20, "sma_slow": 50, "rsi_period": 14, "rsi_oversold": 35.0, "rsi_overbought": 70.0, "stop_pct": 0.03,
    "target_multiplier": 2.5, "min_confidence": 50.0, "trend_strength_min": 0.5, "volume_confirm": 1.2,
    "weight_trend": 0.35, "weight_rsi": 0.25, "weight_momentum": 0.25, "weight_volume": 0.15,
}
LENGTHS = ("rsi_period", "macd_fast", "macd_slow", "macd_signal")
SESSION = ("symbol", "session")


def tradeable(minute="et_minute", open_=575, close=945):
    """Entries from 09:35 to 15:45 ET; an unknown time is allowed."""
    m = F.col(minute)
    return F.coalesce((m >= open_) & (m < close), F.lit(True))


def should_flatten(minute="et_minute", at=945):
    return F.coalesce(F.col(minute) >= at, F.lit(False))


def with_session_flags(bars):
    return bars.withColumn("tradeable", tradeable()).withColumn("flatten", should_flatten())


def day_features(bars, anchor, second, p=DAY):
    """Everything a day signal reads at a bar, as running windows over the session so far."""
    daily = aggs.session_summary(bars).select("symbol", F.col("session").alias("ts"), "close", "volume")
    ctx = joins.daily_context(daily).select("symbol", F.col("ts").alias("session"), "avg_volume_20d")
    b = joins.with_market_context(bars, anchor, second).join(ctx, list(SESSION), "left")
    b = win.session_running(b, "avg_volume_20d")
    b = win.rsi(b, p["rsi_period"], "strict", "rsi", SESSION, eps=1e-10)
    return folds.macd(b, p["macd_fast"], p["macd_slow"], p["macd_signal"], SESSION)


def _signals(scored, p, keep, low, high, low_f, high_f):
    """Direction, levels and sanity checks shared by both strategies; ``p`` maps a name to a column."""
    bull, bear = F.col("bull"), F.col("bear")
    # The generator keeps the filter above the scores: pushed below, it would substitute every
    # step of the chain into itself.
    extra = [c for c in (low, high, "close", "p") if c in scored.columns]
    d = scored.select(*keep, *extra, F.inline(F.array(F.struct("bull", "bear", "confidence"))))
    d = d.withColumn("direction", F.when(bull > bear, "long").when(bear > bull, "short"))
    d = d.filter(F.col("direction").isNotNull() & (F.col("confidence") >= p("min_confidence")))
    d = d.withColumn("entry_price", F.col("close"))
    d = bracket_levels(d, p("stop_pct"), p("target_multiplier"), low, high, low_f, high_f)
    return d.filter(F.when(F.col("direction") == "long", F.col("target_price") > F.col("entry_price")).otherwise(
        F.col("target_price") < F.col("entry_price"))).select(
        *keep, "direction", "confidence", "entry_price", "stop_price", "target_price")


def bracket_levels(df, stop_pct, multiple, low, high, low_f=0.999, high_f=1.001):
    """Stop: the tighter of the default and the natural level on the right side of entry; target: R multiple."""
    e = F.col("entry_price")
    long = F.col("direction") == "long"
    default = F.bround(e * F.when(long, 1.0 - stop_pct).otherwise(1.0 + stop_pct), 4)
    natural = F.bround(F.when(long, F.col(low) * low_f).otherwise(F.col(high) * high_f), 4)
    tight = F.when(long, F.greatest(default, natural)).otherwise(F.least(default, natural))
    df = df.withColumn("stop_price", F.when(F.when(long, e - tight).otherwise(tight - e) <= 0, default).otherwise(tight))
    dist = F.when(long, e - F.col("stop_price")).otherwise(F.col("stop_price") - e)
    return df.withColumn("target_price", F.bround(F.when(long, e + dist * multiple).otherwise(e - dist * multiple), 4))


def day_signals(features, p=DAY, keep=("symbol", "session", "ts")):
    """Score bull against bear at every tradeable bar. ``p``: a dict, or a function name -> column."""
    get = p if callable(p) else (lambda n: F.lit(p[n]))
    rsi, dev, vol = F.col("rsi"), F.col("price_vs_vwap_pct"), F.col("cum_volume_ratio")
    zero = F.lit(0.0)
    f = features.filter(tradeable() & (F.col("bars_so_far") >= 5))
    tiers = (
        F.when(rsi < get("rsi_oversold"), 100.0).when(rsi < get("rsi_very_oversold"), 90.0).when(rsi < get("rsi_strong_oversold"), 80.0)
        .when(rsi < get("rsi_moderate_oversold"), 70.0).when(rsi > get("rsi_overbought"), -100.0)
        .when(rsi < get("rsi_neutral_low"), 60.0).when(rsi > get("rsi_neutral_high"), -60.0).otherwise(0.0))
    vw = F.least(F.lit(100.0), 60.0 + F.abs(dev) * 10.0)
    f = f.withColumn("_t", tiers)
    f = f.withColumns({
        "bull": F.greatest("_t", zero) * get("weight_rsi") + F.when(dev > get("vwap_near_band_pct"), get("weight_vwap") * vw).otherwise(0.0),
        "bear": F.greatest(-F.col("_t"), zero) * get("weight_rsi") + F.when(dev < -get("vwap_near_band_pct"), get("weight_vwap") * vw).otherwise(0.0)})
    vs = F.when(vol >= get("volume_strong_ratio"), 100.0).when(vol >= get("volume_confirm_ratio"), 70.0).when(vol >= 0.80, 40.0).when(vol.isNotNull(), 10.0).otherwise(0.0)
    lead, add, macd = F.col("bull") >= F.col("bear"), get("weight_volume") * vs, get("weight_macd") * 80.0
    f = f.withColumns({
        "bull": F.col("bull") + F.when(lead, add).otherwise(0.0) + F.when((F.col("macd_hist") > 0) & (F.col("macd") > 0), macd).otherwise(0.0),
        "bear": F.col("bear") + F.when(~lead, add).otherwise(0.0) + F.when((F.col("macd_hist") < 0) & (F.col("macd") < 0), macd).otherwise(0.0)})

    def boost(f, up, down, k):
        return f.withColumns({
            "bull": F.col("bull") * F.when(up & (F.col("bull") > F.col("bear")), k).otherwise(1.0),
            "bear": F.col("bear") * F.when(down & (F.col("bear") > F.col("bull")), k).otherwise(1.0)})

    f = boost(f, F.col("regime") == "trending_up", F.col("regime") == "trending_down", 1.10)
    flat = F.col("regime") == "range_bound"
    cheap, dear = flat & (rsi < get("rsi_moderate_oversold")), flat & (rsi > get("rsi_overbought"))
    f = f.withColumns({
        "bull": F.col("bull") * F.when(cheap, 1.15).otherwise(1.0),
        "bear": F.col("bear") * F.when(dear & ~F.coalesce(cheap, F.lit(False)), 1.15).otherwise(1.0)})
    for c in ("spy_change_pct", "qqq_change_pct"):
        f = boost(f, F.col(c) > 0.4, F.col(c) < -0.4, 1.05)
    mult = F.when(F.col("regime") == "volatile", get("volatile_multiplier")).when(F.col("regime") == "unknown", get("unknown_multiplier")).otherwise(1.0)
    f = f.withColumn("confidence", F.least(F.greatest("bull", "bear") * mult, F.lit(95.0)))
    return _signals(f, get, keep, "day_low", "day_high", 0.999, 1.001)


def swing_signals(bars, p=SWING, keep=("symbol", "ts")):
    """Trend, pullback, momentum and volume over daily bars; needs sma_slow+5 bars."""
    b = win.sma(win.sma(bars, p["sma_fast"], out="_fast"), p["sma_slow"], out="_slow")
    b = win.rsi(b, p["rsi_period"], "strict", "rsi", eps=1e-10)
    b = win.recent_range(win.volume_ratio(win.roc(b, 10, "roc")), 10)
    b = b.withColumn("_n", F.row_number().over(win.ordered())).filter((F.col("_n") >= p["sma_slow"] + 5) & F.col("_slow").isNotNull())
    b = b.withColumn("_spread", (F.col("_fast") - F.col("_slow")) / F.col("_slow") * 100).withColumn("_off", (F.col("close") - F.col("_fast")) / F.col("_fast") * 100)
    trend = F.least(F.lit(100.0), 50.0 + F.abs("_spread") * 15.0) * p["weight_trend"]
    up, down = F.col("_spread") > p["trend_strength_min"], F.col("_spread") < -p["trend_strength_min"]
    rsi, roc, vr = F.col("rsi"), F.col("roc"), F.col("volume_ratio")
    # the volume mean must be positive for the ratio to count
    vr = F.when(vr > 0, vr)
    tier = F.when(rsi < p["rsi_oversold"], 90.0).when(rsi > p["rsi_overbought"], -90.0).when(rsi < 45, 50.0).when(rsi > 55, -50.0).otherwise(0.0)
    push = F.least(F.lit(100.0), 40.0 + F.abs(roc) * 8.0) * p["weight_momentum"]
    zero = F.lit(0.0)
    b = b.withColumn("_t", tier)
    b = b.withColumn("bull", F.when(up, trend).otherwise(0.0) + F.greatest("_t", zero) * p["weight_rsi"] + F.when(roc > 2, push).otherwise(0.0))
    b = b.withColumn("bear", F.when(down, trend).otherwise(0.0) + F.greatest(-F.col("_t"), zero) * p["weight_rsi"] + F.when(roc < -2, push).otherwise(0.0))
    vs = F.when(vr.isNull(), 0.0).when(vr >= p["volume_confirm"], F.least(F.lit(100.0), 50.0 + (vr - 1.0) * 40.0)).otherwise(30.0) * p["weight_volume"]
    b = b.withColumn("_lead", F.col("bull") >= F.col("bear"))
    b = b.withColumn("bull", F.col("bull") + F.when(F.col("_lead"), vs).otherwise(0.0)).withColumn("bear", F.col("bear") + F.when(~F.col("_lead"), vs).otherwise(0.0))
    b = b.withColumn("bull", F.col("bull") * F.when(up & (F.col("_off") > -1.5) & (F.col("_off") < 0.5), 1.15).otherwise(1.0))
    b = b.withColumn("bear", F.col("bear") * F.when(down & (F.col("_off") > -0.5) & (F.col("_off") < 1.5), 1.15).otherwise(1.0))
    b = b.withColumn("confidence", F.least(F.greatest("bull", "bear"), F.lit(95.0)))
    return _signals(b, lambda n: F.lit(p[n]), keep, "recent_low", "recent_high", 0.995, 1.005)


def label_brackets(signals, bars, slippage=0.0005, flatten_at=945, keys=SESSION):
    """How each signal would have ended: the first later bar of its session that flattens, stops or
    hits the target (in that order within a bar), else the session's last close.

    A session's bars travel as one array (at most one entry per interval of the day), so a signal
    scans its own session in place and no signal-bar pairs are shuffled.
    """
    arr = bars.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ts", "open", "high", "low", "close", "et_minute"))).alias("_bars"))
    s = signals.join(arr, list(keys))
    long = F.col("direction") == "long"

    def hits(b):
        flat = b["et_minute"] >= flatten_at
        stop = F.when(long, b["low"] <= F.col("stop_price")).otherwise(b["high"] >= F.col("stop_price"))
        target = F.when(long, b["high"] >= F.col("target_price")).otherwise(b["low"] <= F.col("target_price"))
        return (b["ts"] > F.col("ts")) & (flat | stop | target)

    s = s.withColumn("_hit", F.get(F.filter("_bars", hits), F.lit(0))).withColumn("_last", F.element_at("_bars", -1)).drop("_bars")
    h = F.col("_hit")
    stop = F.when(long, h["low"] <= F.col("stop_price")).otherwise(h["high"] >= F.col("stop_price"))
    why = F.when(h.isNull(), "eod").when(h["et_minute"] >= flatten_at, "flatten").when(stop, "stop").otherwise("target")
    s = s.withColumn("exit_reason", why)
    raw = (
        F.when(F.col("exit_reason") == "eod", F.col("_last.close")).when(F.col("exit_reason") == "flatten", h["close"])
        .when(F.col("exit_reason") == "stop", F.when(long, F.least("stop_price", h["open"])).otherwise(F.greatest("stop_price", h["open"])))
        .otherwise(F.when(long, F.greatest("target_price", h["open"])).otherwise(F.least("target_price", h["open"]))))
    s = s.withColumn("entry_fill", fill_price("entry_price", "direction", "entry", slippage))
    s = s.withColumn("exit_fill", fill_price(raw, "direction", "exit", slippage)).withColumn("exit_ts", F.coalesce(h["ts"], F.col("_last.ts")))
    return s.withColumn("pnl_pct", safe_div(trade_pnl("entry_fill", "exit_fill", F.lit(1.0), "direction"), "entry_fill") * 100).drop("_hit", "_last")


def top_signals_per_bar(signals, k=5, by=("ts",)):
    """The k most confident signals of each bar (ties by symbol)."""
    w = W.partitionBy(*by).orderBy(F.desc("confidence"), "symbol")
    return signals.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def best_signal(signals, universe_keys):
    """The most confident signal per symbol; symbols without one are neutral with 0."""
    g = signals.groupBy("symbol").agg(F.max_by(F.struct("direction", "confidence", "ts"), F.struct("confidence", F.expr("-unix_micros(cast(ts as timestamp))"))).alias("s"))
    label = F.when(F.col("s.direction") == "long", "bullish").when(F.col("s.direction") == "short", "bearish").otherwise("neutral")
    return universe_keys.join(g, "symbol", "left").select("symbol", label.alias("signal"), F.coalesce("s.confidence", F.lit(0.0)).alias("confidence"))


def sweep(bars, grid, anchor, second, capital=100_000.0, size=0.15, slippage=0.0005, max_per_bar=5, base=DAY, out_of_sample=None):
    """Score parameter variants in one job; with ``out_of_sample`` = n the last n sessions (side ``out``) apart from the rest (``in``).

    ``grid`` maps a variant name to overrides of the day parameters. Features are built once per
    distinct set of window lengths; the variants with those lengths ride along as one literal array
    (the grid is code, so its size is known), are exploded, and only signals that pass their variant's
    own threshold go on. Trades, curves and fitness are grouped by variant.
    """
    lengths = {}
    for name, over in grid.items():
        p = {**base, **over}
        lengths.setdefault(tuple(p[k] for k in LENGTHS), []).append((name, p))
    parts = []
    for variants in lengths.values():
        feats = day_features(bars, anchor, second, variants[0][1])
        structs = [F.struct(F.lit(name).alias("variant"), *[F.lit(float(v)).alias(k) for k, v in p.items() if k not in LENGTHS]) for name, p in variants]
        x = feats.withColumn("p", F.explode(F.array(*structs))).withColumn("variant", F.col("p.variant"))
        parts.append(day_signals(x, lambda n: F.col(f"p.{n}"), ("variant", "symbol", "session", "ts")))
    sig = top_signals_per_bar(reduce(lambda a, b: a.unionByName(b), parts), max_per_bar, ("variant", "ts"))
    t = label_brackets(sig, bars, slippage)
    shares = F.greatest(F.lit(1.0), F.floor(capital * size / F.col("entry_fill")).cast("double"))
    t = t.withColumn("pnl", trade_pnl("entry_fill", "exit_fill", shares, "direction"))
    won, gone = F.col("pnl") > 0, F.col("pnl") <= 0
    zero = F.lit(0.0)
    day = t.groupBy("variant", "session").agg(
        F.sum("pnl").alias("pnl"), F.count(F.lit(1)).alias("trades"), F.sum(won.cast("long")).alias("wins"),
        F.coalesce(F.sum(F.when(won, F.col("pnl"))), zero).alias("gross_profit"), F.abs(F.coalesce(F.sum(F.when(gone, F.col("pnl"))), zero)).alias("gross_loss"))
    if out_of_sample is None:
        return aggs.daily_metrics(day, capital)
    cut = bars.select("session").distinct().orderBy(F.desc("session")).limit(out_of_sample).agg(F.min("session")).scalar()
    return aggs.daily_metrics(day.withColumn("side", F.when(F.col("session") >= cut, "out").otherwise("in")), capital, keys=("variant", "side"))


def keep_rule(scored, floor=-5.0, incumbent=None):
    """The best variant in sample, kept only if it beats the incumbent and holds out of sample; ``scored`` has variant, side, fitness."""
    at = lambda side: F.max(F.when(F.col("side") == side, F.col("fitness")))
    j = scored.groupBy("variant").agg(at("in").alias("is_fitness"), at("out").alias("oos_fitness")).filter(F.col("is_fitness").isNotNull())
    best = j.agg(F.max_by(F.struct("variant", "is_fitness", "oos_fitness"), F.struct("is_fitness", "variant")).alias("b")).where("b IS NOT NULL").select("b.*")
    ok = F.coalesce("oos_fitness", F.lit(-999.0)) >= floor
    return best.withColumn("kept", ok if incumbent is None else ok & (F.col("is_fitness") > incumbent))


# -- pluggable strategies ---------------------------------------------------------------

STRATEGIES = {}


def strategy(name):
    """Register a strategy: a function from feature bars to signals, both DataFrames."""
    def register(fn):
        STRATEGIES[name] = fn
        return fn
    return register


SIGNAL_SCHEMA = "symbol string, session date, ts timestamp_ntz, direction string, confidence double, entry_price double, stop_price double, target_price double"
SIGNAL_COLUMNS = ["symbol", "session", "ts", "direction", "confidence", "entry_price", "stop_price", "target_price"]


def checked_signals(made, bars, origin):
    """What a strategy returned for one session as a frame of SIGNAL_COLUMNS; raises where the contract is broken.

    A frame, or a list of dicts or objects; None or nothing is no signals. Symbol and session are the bars' where they are missing.
    """
    if made is None or len(made) == 0:
        return pd.DataFrame({c: pd.Series([], dtype=object if c in SIGNAL_COLUMNS[:4] else float) for c in SIGNAL_COLUMNS})
    out = made if isinstance(made, pd.DataFrame) else pd.DataFrame([x if isinstance(x, dict) else vars(x) for x in made])
    out = out.assign(**{c: bars[c].iloc[0] for c in ("symbol", "session") if c not in out.columns})
    missing = [c for c in SIGNAL_COLUMNS if c not in out.columns]
    if missing:
        raise ValueError(f"{origin}: signals lack {', '.join(missing)}")
    sides = set(out["direction"]) - {"long", "short"}
    if sides:
        raise ValueError(f"{origin}: direction {sorted(map(str, sides))[0]!r} is neither long nor short")
    numbers = out[SIGNAL_COLUMNS[4:]].apply(pd.to_numeric, errors="coerce")
    if numbers.isna().any(axis=None):
        raise ValueError(f"{origin}: {', '.join(numbers.columns[numbers.isna().any()])} must be numbers")
    return out.assign(**numbers.astype(float))[SIGNAL_COLUMNS]


def python_strategy(fn, origin="strategy"):
    """Wrap a pandas function of one symbol's session (bounded by the day) as a strategy."""
    def run(pdf):
        pdf = pdf.sort_values("ts")
        return checked_signals(fn(pdf), pdf, origin)
    return lambda features: features.groupBy(*SESSION).applyInPandas(run, SIGNAL_SCHEMA)


def _module(source, origin):
    """A module from its source, made once per process."""
    name = f"strategy_{hashlib.sha1(source.encode()).hexdigest()}"
    if name not in sys.modules:
        module = types.ModuleType(name)
        module.__file__ = origin
        sys.modules[name] = module  # dataclasses look their module up
        try:
            exec(compile(source, origin, "exec"), module.__dict__)
        except BaseException:
            del sys.modules[name]
            raise
    return sys.modules[name]


def load_strategy(spark, path, context=None, name=None):
    """The strategy in a Python file: ``generate_signals(bars, context)`` over one symbol's session.

    The file is read once, on the driver or from any store that Spark reads; its text travels with the tasks, so executors need no
    copy of it. Its contract is checked when it is loaded (the function) and on every session (its signals). With ``name`` it is registered for
    :func:`run_strategy` too.
    """
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            source = f.read()
    else:
        source = spark.read.text(path, wholetext=True).first()[0]
    if not callable(getattr(_module(source, path), "generate_signals", None)):
        raise ValueError(f"{path}: no function generate_signals(bars, context)")
    given = dict(context or {})
    run = python_strategy(lambda bars: _module(source, path).generate_signals(bars, given), path)
    run.generate = lambda bars: _module(source, path).generate_signals(bars, given)
    run.origin = path
    if name:
        STRATEGIES[name] = run
    return run


def register_table_function(spark, name, fn, origin="strategy"):
    """Make a strategy of one session callable from SQL: ``name(TABLE(bars) PARTITION BY (symbol, session) ORDER BY ts)``.

    An Arrow table function: batches of a partition (one session) are gathered and given to ``fn`` as one frame.
    """
    schema = pa.schema([("symbol", pa.string()), ("session", pa.date32()), ("ts", pa.timestamp("us")), ("direction", pa.string()), *[(c, pa.float64()) for c in SIGNAL_COLUMNS[4:]]])

    @F.arrow_udtf(returnType=SIGNAL_SCHEMA)
    class Session:
        def __init__(self):
            self.parts = []

        def eval(self, batch: pa.RecordBatch):
            self.parts.append(batch)
            return iter(())

        def terminate(self):
            if self.parts:
                bars = pa.Table.from_batches(self.parts).to_pandas()
                yield pa.Table.from_pandas(checked_signals(fn(bars), bars, origin), schema, preserve_index=False)

    spark.udtf.register(name, Session)


def run_strategy(name, features):
    return STRATEGIES[name](features)


@strategy("day")
def _day(features):
    return day_signals(features)


# -- experiment analytics ---------------------------------------------------------------

def run_history(runs):
    pct = F.coalesce(F.floor(safe_div("keep_count", "total_experiments") * 100), F.lit(0))
    w = W.partitionBy("mode").orderBy("started")
    return runs.withColumn("keep_pct", pct).withColumn("delta_best", F.col("best_fitness") - F.lag("best_fitness").over(w))


def fitness_trajectory(runs):
    h = run_history(runs)
    return h.groupBy("mode").agg(
        F.count(F.lit(1)).alias("runs"), F.min_by("best_fitness", "started").alias("first_best"), F.max_by("best_fitness", "started").alias("last_best"),
        F.avg("delta_best").alias("avg_delta"), F.min("improvement").alias("min_improvement"), F.max("improvement").alias("max_improvement"),
        F.avg("improvement").alias("avg_improvement"), F.min("baseline_fitness").alias("min_baseline"), F.max("baseline_fitness").alias("max_baseline"))


def best_kept(experiments):
    """The kept experiment with the highest fitness per mode (the earliest on ties)."""
    kept = experiments.filter("kept")
    order = F.struct(F.coalesce("fitness_score", F.lit(-999.0)), -F.col("experiment_id"))
    return kept.groupBy("mode").agg(F.max_by(F.struct("experiment_id", "run_id", "fitness_score"), order).alias("b"), F.count(F.lit(1)).alias("kept")).select("mode", "kept", "b.*")


def diminishing_returns(runs, cut=0.5, n=3):
    w = W.partitionBy("mode").orderBy(F.desc("started"))
    last = runs.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    return last.groupBy("mode").agg((F.bool_and(F.col("improvement") < cut) & (F.count(F.lit(1)) >= n)).alias("diminishing"), F.max("improvement").alias("max_improvement"))


# Hypothesis buckets, first match wins.
BUCKETS = [
    ("MACD parameters", ["macd", "ema", "macd_fast", "macd_slow"]),
    ("MIN_CONFIDENCE", ["min_confidence", "confidence threshold"]),
    ("STOP_PCT / TARGET", ["stop_pct", "target_multiplier", "stop loss", "r:r"]),
    ("VWAP bands", ["vwap", "vwap_near_band"]),
    ("RSI thresholds", ["rsi", "rsi_oversold", "rsi_overbought"]),
    ("Regime multipliers", ["regime", "regime_multiplier"]),
    ("Time filters", ["no_trade_open", "market_close", "time filter"]),
    ("Volume / acceleration", ["volume", "vol_accel"]),
    ("Confidence weights", ["conf_weight", "confidence weight"]),
    ("Trailing stop", ["trailing stop"]),
]


def hypothesis_frequency(experiments, buckets=BUCKETS):
    h = F.lower("hypothesis")
    bucket = None
    for name, words in buckets:
        hit = reduce(lambda a, b: a | b, [F.contains(h, F.lit(w)) for w in words])
        bucket = F.when(hit, name) if bucket is None else bucket.when(hit, name)
    e = experiments.filter(F.col("hypothesis").isNotNull() & ~h.isin("", "unknown", "agent_error", "syntax_error"))
    return e.groupBy(bucket.otherwise("(other)").alias("bucket")).agg(F.count(F.lit(1)).alias("tried"), F.count(F.when(F.col("kept"), 1)).alias("kept"))


SPARK_CHARS = "▁▂▃▄▅▆▇█"


def sparkline(df, keys, order, value):
    """One character per value of an ordered series; a flat series is all fifth characters.

    The series of a key is one line of text, so its length is what the caller asks to see.
    """
    chars = F.array(*[F.lit(c) for c in SPARK_CHARS])
    g = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("_s"),
                              F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    char = F.transform("_s", lambda x: F.when(span == 0, SPARK_CHARS[4]).otherwise(
        F.get(chars, ((x["v"] - F.col("_lo")) / F.nullif(span, F.lit(0.0)) * 7).cast("int"))))
    return g.select(*keys, F.array_join(char, "").alias("sparkline"))
