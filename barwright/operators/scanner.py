"""Market scan: movers, ranking, watch lists and ordered output."""

from functools import reduce

from pyspark.sql import Window as W, functions as F

# Symbols never scanned, and the core watch list.
EXCLUDE = ["TQQQ", "SQQQ", "SOXL", "SOXS", "UPRO", "SPXU", "TZA", "TNA", "UVXY", "VXX", "SVXY", "SPDN", "GOVT"]
CORE = ["NVDA", "AVGO", "TSM", "AMD", "MSFT", "AAPL", "META", "GOOGL", "AMZN", "SPY", "QQQ"]


def eligible_symbol(c, exclude=EXCLUDE):
    """One to five characters, no warrant, unit or right suffix beyond three, not excluded."""
    c = F.col(c) if isinstance(c, str) else c
    n = F.length(c)
    suffix = c.endswith("W") | c.endswith("U") | c.endswith("R")
    return F.coalesce((n >= 1) & (n <= 5) & ~(suffix & (n > 3)) & ~c.isin(exclude), F.lit(False))


def merge_movers(gainers, losers, actives, snaps, min_price=10.0, min_trades=5000, max_change=40.0):
    """Movers and active symbols as one row each; a symbol both up and down counts as a loser."""
    def movers(df, source):
        ok = eligible_symbol("symbol") & (F.col("price") >= min_price) & (F.abs("percent_change") < max_change)
        return df.filter(ok).select("symbol", F.lit(source).alias("source"), "price", F.bround("percent_change", 2).alias("change_pct"))

    up, down = movers(gainers, "gainer"), movers(losers, "loser")
    m = down.unionByName(up.join(down, "symbol", "left_anti"))
    a = actives.filter(eligible_symbol("symbol") & (F.col("trade_count") >= min_trades)).select("symbol", "trade_count", "volume", F.lit(True).alias("_a"))
    j = m.join(a, "symbol", "full")
    src = F.when(F.col("source").isNull(), "active").when(F.col("_a"), F.concat("source", F.lit("+active"))).otherwise(F.col("source"))
    px = snaps.select("symbol", F.coalesce("trade_price", "daily_close").alias("_px"))
    j = j.join(px, "symbol", "left").withColumn("price", F.coalesce("price", "_px"))
    return j.filter(F.col("price") >= min_price).select("symbol", src.alias("source"), "price", "change_pct", "trade_count", "volume")


def rank_candidates(df, core=CORE, max_tickers=25):
    """Core first in its order, then the best max(max_tickers - core, 5) others by relevance."""
    score = (F.when(F.col("source").contains("+"), 100.0).otherwise(0.0) + F.when(F.col("source").rlike("gainer|loser"), 50.0).otherwise(0.0)
             + F.least(F.coalesce("trade_count", F.lit(0)) / 10000, F.lit(50.0)))
    slots = max(max_tickers - len(core), 5)
    top = df.filter(~F.col("symbol").isin(core)).withColumn("score", score).orderBy(F.desc("score"), "symbol").limit(slots)
    top = top.select("symbol", "source", "score", F.lit(len(core)).alias("_base"))
    ranked = top.withColumn("rank", F.row_number().over(W.partitionBy("_base").orderBy(F.desc("score"), "symbol")) + F.col("_base")).drop("_base")
    head = df.sparkSession.createDataFrame([(s, "core", None, i + 1) for i, s in enumerate(core)], "symbol string, source string, score double, rank int") if core else None
    return ranked if head is None else head.unionByName(ranked)


def top_n(df, key, n, tie="symbol"):
    return df.orderBy(F.desc(key), tie).limit(n)


def ordered_signals(signals, order):
    """Rank of each signal's analyst in a fixed display order, unknown ones last."""
    m = F.create_map(*[F.lit(x) for i, a in enumerate(order) for x in (a, i)])
    return signals.withColumn("position", F.coalesce(F.try_element_at(m, F.col("analyst")), F.lit(len(order)))).orderBy("position", "analyst")


def watchlist(*parts):
    """Distinct symbols of several sources; each keeps its earliest source."""
    u = reduce(lambda a, b: a.unionByName(b), [p.select("symbol", F.lit(i).alias("priority")) for i, p in enumerate(parts)])
    return u.groupBy("symbol").agg(F.min("priority").alias("priority"))


def risk_universe(requested, held):
    return requested.select("symbol").union(held.select("symbol")).distinct()
