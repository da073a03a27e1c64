"""Trading universes and risk limits as small dimension tables.

Fixed values: the published mode configuration (tickers, caps, limits). These dimensions are
literals of a few dozen rows, so they are broadcast.
"""

from pyspark.sql import functions as F

UNIVERSE = {
    "swing": [
        ("core_tech", "Core Technology", ["NVDA", "AVGO", "TSM", "MSFT", "AAPL", "GOOGL", "META", "AMZN"], 0.30, 0.08),
        ("growth", "Growth", ["PLTR", "AMD", "CRM", "SNOW", "NET", "PANW"], 0.25, 0.08),
        ("value_dividend", "Value & Dividend", ["JPM", "V", "UNH", "JNJ", "PG", "KO"], 0.25, 0.08),
        ("tactical", "Tactical", ["COIN", "MSTR", "RKLB", "SMCI"], 0.15, 0.05),
        ("hedge", "Hedge / Direction", ["SPY", "QQQ", "GLD", "TLT"], 0.15, 0.10),
    ],
    "day": [
        ("mega_cap", "Mega-Cap Liquid", ["NVDA", "AVGO", "TSM", "AMD", "MSFT", "AAPL", "META", "GOOGL", "AMZN"], 0.50, 0.15),
        ("momentum", "Momentum", ["PLTR", "COIN", "MSTR", "RKLB", "SMCI"], 0.35, 0.12),
        ("etf_direction", "ETF Direction / Hedge", ["SPY", "QQQ", "TQQQ", "SOXL"], 0.30, 0.15),
    ],
}

RISK_FIELDS = [
    "max_position_pct", "max_sector_pct", "stop_loss_pct", "trailing_stop_pct", "daily_loss_limit", "weekly_loss_limit",
    "no_buy_if_down_pct", "max_trades_per_day", "max_open_positions", "min_cash_pct", "max_tactical_pct",
    "flatten_eod", "flatten_minute", "allow_leveraged_etfs",
]
RISK = {
    "swing": (0.08, 0.30, 0.07, 0.15, 0.02, 0.05, 0.03, 4, 12, 0.20, 0.03, False, None, False),
    "day": (0.15, 0.50, 0.012, 0.03, 0.03, 0.08, 0.02, 20, 8, 0.10, 1.0, True, 945, True),
}
LEVERAGED = ["TQQQ", "SOXL", "UPRO", "SPXL", "TECL", "LABU", "SOXS", "TECS", "SPXS", "SQQQ", "SDOW", "UDOW", "NAIL", "CURE", "HIBL", "HIBS"]
MOONSHOTS = ["IONQ", "RGTI", "SOUN", "LUNR"]


def risk(mode):
    return dict(zip(RISK_FIELDS, RISK[mode]))


def universe_df(spark, mode=None):
    """One row per (mode, sector, symbol), with the sector's rank, size and caps."""
    rows = [
        (m, i, sector, label, sym, j, len(syms), cap, per)
        for m, sectors in UNIVERSE.items() if mode in (None, m)
        for i, (sector, label, syms, cap, per) in enumerate(sectors)
        for j, sym in enumerate(syms)
    ]
    return spark.createDataFrame(
        rows, "mode string, sector_rank int, sector string, label string, symbol string, rank int, n_symbols int, "
              "max_sector_pct double, max_per_stock_pct double")


def sectors_df(spark, mode):
    return universe_df(spark, mode).select("sector", "label", "n_symbols", "max_sector_pct").distinct()


def risk_limits_df(spark):
    rows = [(m, *v) for m, v in RISK.items()]
    kinds = ["double"] * 7 + ["int"] * 2 + ["double"] * 2 + ["boolean", "int", "boolean"]
    return spark.createDataFrame(rows, "mode string, " + ", ".join(f"{n} {t}" for n, t in zip(RISK_FIELDS, kinds)))


def universe_symbols(spark, mode):
    return universe_df(spark, mode).select("symbol").distinct().orderBy("symbol")


def with_sector(df, spark, mode, default="other"):
    """Sector of each symbol; the first listed sector wins."""
    u = universe_df(spark, mode).groupBy("symbol").agg(F.min_by("sector", "sector_rank").alias("sector"))
    return df.join(F.broadcast(u), "symbol", "left").withColumn("sector", F.coalesce("sector", F.lit(default)))
