"""Volatility and correlation limits, pre-trade rules, alerts and stop checks."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Window as W, functions as F

from barwright.functions.numeric import col, corr_multiplier, reason, safe_div, vol_limit
from barwright.operators import windows as win
from barwright.sources import universe


# -- volatility and correlation ---------------------------------------------------------

def volatility_pack(bars, lookback=60, window=30):
    """Volatility of the last returns, annualised, and its rank among rolling volatilities."""
    b = win.vol_percentile(bars, window)
    newest = W.partitionBy("symbol").orderBy(F.desc("ts"))
    b = b.withColumn("_r", F.row_number().over(newest))
    recent = F.when(F.col("_r") <= lookback, F.col("ret"))
    b = b.withColumn("_dv", F.stddev_samp(recent).over(W.partitionBy("symbol")))
    g = b.groupBy("symbol").agg(
        F.max("_dv").alias("_dv"), F.count("ret").alias("_n"), F.count(recent).alias("_k"), F.count(F.lit(1)).alias("_bars"),
        F.avg(F.when(F.col("roll_vol").isNotNull(), (F.col("roll_vol") <= F.col("_dv")).cast("double"))).alias("_p"),
        F.max_by("close", "ts").alias("price"))
    short = F.col("_n") < 2
    daily = F.when(short, 0.05).otherwise(F.coalesce("_dv", F.lit(0.025)))
    annual = F.when(short, 0.05 * math.sqrt(252)).otherwise(F.coalesce(F.col("_dv") * math.sqrt(252), F.lit(0.25)))
    pct = F.when(short, 100.0).when(F.col("_n") < window, 50.0).otherwise(F.coalesce(F.col("_p") * 100, F.lit(50.0)))
    return g.select("symbol", daily.alias("daily_volatility"), annual.alias("annualized_volatility"), pct.alias("volatility_percentile"),
                    F.when(F.col("_bars") < 2, F.col("_bars")).when(short, F.col("_n")).otherwise(F.col("_k")).alias("data_points"), "price")


#: Symbols in a block of the correlation products: a tile is BLOCK by BLOCK, its rows as long as the calendar.
BLOCK = 256


def standardised(bars, min_dates=5):
    """One row per symbol: its returns, standardised, over the dates on which every symbol has one, in order of time (bounded by the calendar)."""
    rets = win.returns(bars).filter(F.col("ret").isNotNull()).select("symbol", "ts", "ret")
    per_date = rets.groupBy("ts").agg(F.count(F.lit(1)).alias("_k"))
    symbols = rets.select("symbol").distinct()
    full = per_date.filter(F.col("_k") == symbols.agg(F.count(F.lit(1))).scalar()).select("ts")
    rets = rets.join(full, "ts", "left_semi")
    series = rets.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("ts", "ret"))).alias("_r"), F.avg("ret").alias("_m"), F.stddev_samp("ret").alias("_s"))
    z = F.transform("_r", lambda x: safe_div(x["ret"] - F.col("_m"), "_s"))
    return series.filter(F.size("_r") >= min_dates).select("symbol", z.alias("z"))


def _packed(z, size, prefix):
    """Blocks of about ``size`` symbols as one row each, and how many there are (a column)."""
    many = F.greatest(F.lit(1), F.ceil(z.agg(F.count(F.lit(1)) / size).scalar())).cast("int")
    rows = z.select("symbol", "z", F.pmod(F.xxhash64("symbol"), many).cast("int").alias(f"{prefix}b"))
    return rows.groupBy(f"{prefix}b").agg(F.collect_list(F.struct("symbol", "z")).alias(f"{prefix}rows")), many


def _tiles(left, right, size, upper=False):
    """Every block of ``left`` beside every block of ``right`` (of those at or after it where ``upper``)."""
    a, _ = _packed(left, size, "l")
    b, many = _packed(right, size, "r")
    a = a.select("lb", "lrows", F.explode(F.sequence(F.col("lb") if upper else F.lit(0), many - 1)).alias("_at"))
    return a.join(b, F.col("_at") == F.col("rb")).select("lb", "lrows", "rb", "rrows")


def _products(row):
    """Correlations of a tile (rows of the left block by rows of the right one) with both lists of symbols; NaN where returns do not vary."""
    (ls, l), (rs, r) = (([x["symbol"] for x in row[k]], np.array([x["z"] for x in row[k]], float)) for k in ("lrows", "rrows"))
    return ls, rs, l @ r.T / (l.shape[1] - 1)


def correlation_matrix(bars, size=BLOCK, min_dates=5):
    """Correlation of returns over the dates on which every symbol has one; null where a symbol's returns do not vary.

    A blocked matrix product over the symbols' series; only tiles on and above the diagonal are computed, and mirrored. Every series is
    copied once per block of ``size`` symbols.
    """
    def run(frames):
        for pdf in frames:
            for row in pdf.to_dict("records"):
                ls, rs, c = _products(row)
                at = np.triu_indices(len(ls), 1) if row["lb"] == row["rb"] else tuple(x.ravel() for x in np.indices(c.shape))
                yield pd.DataFrame({"a": np.array(ls, object)[at[0]], "b": np.array(rs, object)[at[1]], "corr": c[at]})

    z = standardised(bars, min_dates)
    half = _tiles(z, z, size, True).mapInPandas(run, "a string, b string, corr double")
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return half.select(both.alias("p"), F.when(~F.isnan("corr"), F.col("corr")).alias("corr")).select("p.a", "p.b", "corr")


def correlation_partners(bars, active, top=3, size=BLOCK, min_dates=5):
    """Mean, max and top partners per symbol among the active ones, or among all others if none is active besides itself.

    Tiles are symbols by active symbols; symbols left without a partner meet all. A task reduces its tile to count, sum, max and the first ``top``
    of each symbol, so nothing grows with the square of the symbols but the products themselves.
    """
    def run(frames):
        for pdf in frames:
            for row in pdf.to_dict("records"):
                ls, rs, c = _products(row)
                names, out = np.array(rs, object), []
                for s, line in zip(ls, c):
                    other = names != s
                    known = line[other & ~np.isnan(line)]
                    best = sorted((np.isnan(v), -v if v == v else 0.0, b) for v, b in zip(line[other], names[other]))[:top]
                    out.append((s, int(other.sum()), len(known), float(known.sum()), [{"none": bool(n), "down": float(d), "b": b} for n, d, b in best]))
                yield pd.DataFrame(out, columns=["symbol", "others", "n", "total", "best"])

    schema = "symbol string, others long, n long, total double, best array<struct<none: boolean, down: double, b: string>>"
    z = standardised(bars, min_dates)
    mine = z.join(active.select("symbol").distinct(), "symbol", "left_semi")
    held = mine.agg(F.count(F.lit(1))).scalar()
    alone = z.join(mine.select(F.col("symbol").alias("_own")), F.col("symbol") == F.col("_own"), "left").filter(held - F.col("_own").isNotNull().cast("long") == 0)
    tiles = _tiles(z, mine, size).unionByName(_tiles(alone.select("symbol", "z"), z, size))
    g = tiles.mapInPandas(run, schema).filter(F.col("others") > 0).groupBy("symbol").agg(
        F.sum("n").alias("_n"), F.sum("total").alias("_t"), F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, top).alias("_best"))
    first = F.get("_best", F.lit(0))
    return g.select("symbol", F.when(F.col("_n") > 0, F.col("_t") / F.col("_n")).alias("avg_correlation"), F.when(~first["none"], -first["down"]).alias("max_correlation"),
                    F.array_join(F.transform("_best", lambda x: x["b"]), ",").alias("top_correlated"))


def risk_limits(pos, accounts, vols, corr):
    """Dollar limit left per account and symbol: value x volatility limit x correlation multiplier,
    less what is held, capped by cash. May be negative; 0 without a price."""
    value = pos.join(vols.select("symbol", "price"), "symbol").groupBy("account").agg(
        F.sum((F.col("long") - F.col("short")) * F.col("price")).alias("_held"))
    acc = accounts.select("account", "cash").join(value, "account", "left").withColumn(
        "total_value", F.col("cash") + F.coalesce("_held", F.lit(0.0)))
    j = pos.join(vols, "symbol", "left").join(corr.select("symbol", "avg_correlation"), "symbol", "left").join(acc, "account")
    pct = vol_limit(F.coalesce("annualized_volatility", F.lit(0.25))) * corr_multiplier("avg_correlation")
    held = F.abs((F.col("long") - F.col("short")) * F.col("price"))
    limit = F.least(F.col("total_value") * pct - held, F.col("cash"))
    ok = F.col("price") > 0
    return j.select("account", "symbol", F.when(ok, F.col("price")).otherwise(0.0).alias("current_price"),
                    F.when(ok, pct).alias("limit_pct"), F.when(ok, limit).otherwise(0.0).alias("remaining_position_limit"))


def whole_shares(money, price):
    """Whole shares that the money pays for; a quotient within 1e-9 of a whole number is that number."""
    return F.when(price > 0, F.floor(F.round(money / price, 9))).otherwise(0)


def decision_frame(signals, limits):
    """Signals left-joined to the limits of their account and symbol, as the input of a decision."""
    lim = limits.withColumn("max_shares", whole_shares(F.col("remaining_position_limit"), F.col("current_price")))
    return signals.join(lim, ["account", "symbol"], "left").fillna(0, ["max_shares"]).fillna(0.0, ["current_price", "remaining_position_limit"])


def allowed_actions(frame):
    """Largest quantity per action as a map; zeros are pruned, hold stays.

    ``frame``: long, short, cash, equity, margin_requirement, margin_used, current_price, max_shares.
    """
    price, cap = F.col("current_price"), F.col("max_shares").cast("long")
    zero = F.lit(0).cast("long")
    buy = F.when((F.col("cash") > 0) & (price > 0), F.greatest(zero, F.least(cap, whole_shares(F.col("cash"), price)))).otherwise(zero)
    room = F.greatest(F.lit(0.0), safe_div("equity", "margin_requirement") - F.col("margin_used"))
    short = F.when((price > 0) & (cap > 0), F.when(F.col("margin_requirement") <= 0, cap).otherwise(
        F.greatest(zero, F.least(cap, whole_shares(room, price))))).otherwise(zero)
    all_ = F.create_map(
        F.lit("buy"), buy, F.lit("sell"), F.col("long").cast("long"), F.lit("short"), short,
        F.lit("cover"), F.col("short").cast("long"), F.lit("hold"), zero)
    return frame.withColumn("allowed", F.map_filter(all_, lambda k, v: (k == "hold") | (v > 0)))


# -- pre-trade rules --------------------------------------------------------------------

def account_state(accounts, pos, orders, weekly, spark, mode):
    """One row per account: cash share, daily and weekly result, open positions, buys today.

    ``orders``: account, side, status for the day; ``weekly``: account, weekly_pnl_pct.
    """
    open_ = pos.groupBy("account").agg(F.count(F.when(F.col("qty") > 0, 1)).alias("open_position_count"))
    dead = ["canceled", "expired", "rejected"]
    buys = orders.filter((F.col("side") == "buy") & ~F.col("status").isin(dead)).groupBy("account").agg(F.count(F.lit(1)).alias("trade_count_today"))
    a = accounts.join(open_, "account", "left").join(buys, "account", "left").join(weekly, "account", "left")
    return a.select(
        "account", "equity", "cash", F.coalesce(safe_div("cash", "equity"), F.lit(0.0)).alias("cash_pct"),
        F.coalesce(safe_div(F.col("equity") - F.col("last_equity"), "last_equity"), F.lit(0.0)).alias("daily_pnl_pct"),
        F.coalesce("weekly_pnl_pct", F.lit(0.0)).alias("weekly_pnl_pct"),
        F.coalesce("open_position_count", F.lit(0)).alias("open_position_count"),
        F.coalesce("trade_count_today", F.lit(0)).alias("trade_count_today"))


def validate_trades(proposals, state, pos, spark, mode):
    """First broken rule per proposal, in rule order; exits and holds pass.

    Every proposal is judged against the same state. ``proposals``: account, symbol, action,
    qty, entry_price (+ anything). Adds approved and rule. What an account holds is one row, with a
    map of its symbols and its sectors' sums, so proposals are shuffled once, by account, before any column is added.
    """
    lim = universe.risk(mode)
    u = universe.universe_df(spark, mode).groupBy("symbol").agg(
        F.max_by("sector", "sector_rank").alias("sector"), F.max_by("max_sector_pct", "sector_rank").alias("max_sector_pct"),
        F.max_by("max_per_stock_pct", "sector_rank").alias("max_per_stock_pct"))
    lots = pos.where(F.col("symbol").isNotNull()).groupBy("account", F.col("symbol").alias("_sym")).agg(F.sum("qty").alias("_q"), F.sum("market_value").alias("_v"))
    placed = lots.join(F.broadcast(u.withColumnRenamed("symbol", "_sym")), "_sym", "left")
    high = (F.col("sector") == "tactical") | F.col("_sym").isin(universe.MOONSHOTS)
    sectors = [name for name, *_ in universe.UNIVERSE[mode]]
    book = placed.groupBy("account").agg(
        F.map_from_entries(F.collect_list(F.struct("_sym", F.struct("_q", "_v")))).alias("_held"), F.sum(F.when(high, F.col("_v"))).alias("_tactical"),
        F.array(*[F.sum(F.when(F.col("sector") == name, F.col("_v"))) for name in sectors]).alias("_sectors"))
    j = proposals.join(state.join(book, "account", "left"), "account", "left").withColumn("action", F.lower("action")).withColumn("_sym", F.upper("symbol"))
    j = j.join(F.broadcast(u.withColumnRenamed("symbol", "_sym")), "_sym", "left").withColumn("_lot", F.try_element_at("_held", "_sym"))
    j = j.withColumns({"_held_qty": F.col("_lot._q"), "_held_value": F.col("_lot._v"),
                       "_sector_value": F.coalesce(*[F.when(F.col("sector") == name, F.col("_sectors")[i]) for i, name in enumerate(sectors)])})
    value = F.col("qty") * F.col("entry_price")
    existing = F.coalesce("_held_value", F.lit(0.0))

    def share(x):
        return F.coalesce(safe_div(x, "equity"), F.lit(0.0))

    new = F.col("_held_qty").isNull() | (F.col("_held_qty") == 0)
    per_stock = F.coalesce("max_per_stock_pct", F.lit(lim["max_position_pct"]))
    rules = [
        ("unknown_action", ~F.col("action").isin("buy", "short")),
        ("no_account_state", F.col("equity").isNull()),
        ("no_leveraged_etfs", F.col("_sym").isin(universe.LEVERAGED) & F.lit(not lim["allow_leveraged_etfs"])),
        ("moonshot_blocked", F.col("_sym").isin(universe.MOONSHOTS)),
        ("daily_circuit_breaker", F.col("daily_pnl_pct") <= -lim["daily_loss_limit"]),
        ("no_buy_down_pct", (F.col("action") == "buy") & (F.col("daily_pnl_pct") <= -lim["no_buy_if_down_pct"])),
        ("weekly_circuit_breaker", F.col("weekly_pnl_pct") <= -lim["weekly_loss_limit"]),
        ("max_trades_per_day", F.col("trade_count_today") >= lim["max_trades_per_day"]),
        ("max_open_positions", new & (F.col("open_position_count") >= lim["max_open_positions"])),
        ("min_cash_reserve", share(F.col("cash") - value) < lim["min_cash_pct"]),
        ("max_position_size", share(existing + value) > per_stock),
        ("max_sector_pct", F.col("sector").isNotNull() & (share(F.coalesce("_sector_value", F.lit(0.0)) + value) > F.col("max_sector_pct"))),
        ("max_tactical_pct", F.lit(lim["max_tactical_pct"] < 1.0) & high & (share(F.coalesce("_tactical", F.lit(0.0)) + value) > lim["max_tactical_pct"])),
    ]
    exit_ = F.col("action").isin("sell", "cover", "hold")
    first = F.coalesce(*[F.when(cond, F.lit(name)) for name, cond in rules])
    j = j.withColumn("rule", F.when(~exit_, first)).withColumn("approved", F.col("rule").isNull())
    return j.select(*proposals.columns, "approved", "rule")


def first_proposals(proposals, mode, order=("seq",)):
    """Only the first max_trades_per_day proposals of an account are looked at."""
    w = W.partitionBy("account").orderBy(*order)
    return proposals.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= universe.risk(mode)["max_trades_per_day"]).drop("_r")


def validate_positions(proposals, pos, accounts, max_trade_pct=0.15):
    """Sells need a long, covers a short, and no trade may exceed its share of the account."""
    held = pos.select("account", "symbol", F.col("qty").alias("_q"), F.col("current_price").alias("_px"))
    j = proposals.join(held, ["account", "symbol"], "left").join(accounts.select("account", "equity"), "account", "left")
    q = F.coalesce("_q", F.lit(0))
    why = (F.when((F.col("action") == "sell") & (q <= 0), "no long position")
           .when((F.col("action") == "cover") & (q >= 0), "no short position")
           .when((F.col("_px") > 0) & (F.col("qty") * F.col("_px") > F.col("equity") * max_trade_pct), "trade too large"))
    return j.withColumn("reject_reason", why).withColumn("valid", why.isNull()).select(*proposals.columns, "valid", "reject_reason")


def audit_trades(proposals, pos, accounts, max_pct=10.0):
    """Proposals worth more than 10 % of equity at the held position's price."""
    held = pos.select("account", "symbol", F.col("current_price").alias("_px"))
    j = proposals.join(held, ["account", "symbol"]).join(accounts.select("account", "equity"), "account")
    pct = safe_div(F.col("qty").cast("int") * F.col("_px"), "equity") * 100
    return j.filter((F.col("_px") > 0) & (F.col("equity") > 0) & (pct > max_pct)).select(
        *proposals.columns, pct.alias("trade_pct"), F.lit(max_pct).alias("threshold"))


def order_brackets(df, stop_pct=0.07, multiple=3.0):
    """Default stop and target of entries, rounded half-even to cents; given prices are kept."""
    entry = F.col("action").isin("buy", "cover", "short") & ~F.coalesce(F.col("order_type"), F.lit("market")).isin("limit", "stop", "trailing_stop", "oco")
    ref = F.coalesce(F.expr("nullif(entry_price, 0)"), F.expr("nullif(limit_price, 0)"), F.lit(0.0))
    sign = F.when(F.col("action") == "short", -1.0).otherwise(1.0)
    on = entry & (ref > 0)
    stop = F.coalesce("stop_price", F.when(on, F.bround(ref * (1 - sign * stop_pct), 2)))
    df = df.withColumn("stop_price", stop)
    target = F.when(on & F.col("stop_price").isNotNull(), F.bround(ref + sign * F.abs(ref - F.col("stop_price")) * multiple, 2))
    return df.withColumn("take_profit", F.coalesce("take_profit", target))


def order_class(df):
    """Which kind of order is sent: bracket, oco, limit, stop, trailing_stop or market."""
    kind = F.coalesce(F.col("order_type"), F.lit("market"))
    both = F.col("stop_price").isNotNull() & F.col("take_profit").isNotNull()
    return df.withColumn("order_class", (
        F.when((kind == "bracket") | (both & (kind != "oco")), "bracket").when((kind == "oco") & both, "oco")
        .when((kind == "limit") & F.col("limit_price").isNotNull(), "limit").when((kind == "stop") & F.col("stop_price").isNotNull(), "stop")
        .when((kind == "trailing_stop") & F.col("trail_percent").isNotNull(), "trailing_stop").otherwise("market")))


def execution_summary(results, keys=("account",)):
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_trades"), F.count(F.when(F.col("approved"), 1)).alias("executed"),
        F.count(F.when(~F.col("approved"), 1)).alias("blocked"))


# -- alerts and stops -------------------------------------------------------------------

def concentration_alerts(pos, accounts, spark, mode):
    """Positions above the mode's cap and sectors above their own."""
    lim = universe.risk(mode)
    eq = accounts.filter(F.col("equity") > 0).select("account", "equity")
    p = pos.join(eq, "account").withColumn("value", F.col("market_value") / F.col("equity") * 100)
    cap = lim["max_position_pct"] * 100
    single = p.filter(F.col("value") > cap).select(
        "account", F.lit("position_concentration").alias("type"), F.col("symbol").alias("subject"), "value", F.lit(cap).alias("threshold"))
    sec = universe.with_sector(pos, spark, mode).groupBy("account", "sector").agg(F.sum("market_value").alias("_v")).join(eq, "account")
    sec = sec.join(F.broadcast(universe.sectors_df(spark, mode)), "sector", "left")
    sec_cap = F.coalesce("max_sector_pct", F.lit(lim["max_sector_pct"])) * 100
    sec = sec.select("account", F.lit("sector_concentration").alias("type"), F.col("sector").alias("subject"),
                     (F.col("_v") / F.col("equity") * 100).alias("value"), sec_cap.alias("threshold"))
    return single.unionByName(sec.filter(F.col("value") > F.col("threshold")))


def cash_alerts(accounts, mode):
    floor = universe.risk(mode)["min_cash_pct"] * 100
    pct = F.col("cash") / F.col("equity") * 100
    return accounts.filter(F.col("equity") > 0).filter(pct < floor).select(
        "account", F.lit("low_cash").alias("type"), pct.alias("value"), F.lit(floor).alias("threshold"))


def drawdown_alerts(equity, max_pct=10.0):
    from barwright.operators.aggs import current_drawdown
    return current_drawdown(equity).filter(F.col("drawdown_pct") > max_pct).select(
        "account", F.lit("drawdown").alias("type"), F.col("drawdown_pct").alias("value"), F.lit(max_pct).alias("threshold"))


def frequency_alerts(journal, mode):
    from barwright.operators.aggs import trades_per_day
    cap = universe.risk(mode)["max_trades_per_day"]
    return trades_per_day(journal).filter(F.col("trades") > cap).select(
        "day", F.lit("high_frequency").alias("type"), F.col("trades").alias("value"), F.lit(cap).cast("long").alias("threshold"))


def stop_check(pos, highs, mode):
    """Breached hard or trailing stops of longs, and warnings from 80 % of the way there.

    ``highs``: symbol, intraday_high. The hard stop has priority.
    """
    lim = universe.risk(mode)
    hard, trail = lim["stop_loss_pct"], lim["trailing_stop_pct"]
    p = pos.filter(F.col("qty") > 0).join(highs, "symbol", "left")
    cur = F.when(F.col("current_price") > 0, F.col("current_price"))
    from_entry = F.when(F.col("avg_entry_price") > 0, (cur - F.col("avg_entry_price")) / F.col("avg_entry_price"))
    from_high = F.when(F.col("intraday_high") > 0, (cur - F.col("intraday_high")) / F.col("intraday_high"))
    kind = F.when(from_entry <= -hard, "hard_stop").when(from_high <= -trail, "trailing_stop")
    near_h = F.when(from_entry <= -hard * 0.8, "approaching hard stop")
    near_t = F.when(from_high <= -trail * 0.8, "approaching trailing stop")
    return p.select("account", "symbol", F.col("qty").cast("long").alias("qty"), from_entry.alias("from_entry"), from_high.alias("from_high"),
                    kind.alias("stop_type"), F.when(kind.isNull(), reason(near_h, near_t)).otherwise("").alias("warning")
                    ).filter(F.col("stop_type").isNotNull() | (F.col("warning") != ""))


def out_of_universe(pos, spark, mode, min_value=None):
    u = universe.universe_df(spark, mode).select("symbol").distinct()
    out = pos.join(F.broadcast(u), "symbol", "left_anti")
    return out if min_value is None else out.filter(F.col("market_value") > min_value)


def in_universe(df, spark, mode):
    return df.join(F.broadcast(universe.universe_df(spark, mode).select("symbol").distinct()), "symbol", "left_semi")


def rebalance_plan(pos, spark, mode):
    """Sell all of every long outside the universe."""
    out = out_of_universe(pos, spark, mode).withColumn("qty", F.col("qty").cast("int")).filter(F.col("qty") > 0)
    return out.select("account", "symbol", F.lit("sell").alias("action"), "qty")


def flatten_plan(pos):
    q = F.col("qty").cast("int")
    return pos.filter(q != 0).select("account", "symbol", F.when(q > 0, "sell").otherwise("buy").alias("side"), F.abs(q).alias("qty"))


def big_movers(pos, pct=5.0):
    return pos.filter(F.abs(F.col("unrealized_plpc") * 100) > pct)


def pulse(snaps, pct=3.0):
    """``snaps``: symbol, prev_close, current. Moves of more than 3 % against the previous close."""
    chg = safe_div(F.col("current") - F.col("prev_close"), "prev_close") * 100
    return snaps.withColumn("change_pct", chg).filter(F.abs(chg) > pct)
