"""Adapters: the canonical market frames, derived from the driver's tables.

Bars are one row per (symbol, interval). They are grouped aggregates with map-side
partials, so a symbol that owns a third of all ticks shrinks to its calendar before the
shuffle; what follows by symbol is bounded by the calendar, not by the input.
"""

from pyspark.sql import Window as W, functions as F


# The twenty tickers that keys are mapped onto.
TICKERS = ["NVDA", "AVGO", "MSFT", "AAPL", "PLTR", "AMD", "CRM", "JPM", "V", "KO",
           "COIN", "MSTR", "SPY", "QQQ", "TQQQ", "SOXL", "IONQ", "F", "ABCDW", "GME"]


def ticker(key):
    return F.element_at(F.array(*map(F.lit, TICKERS)), (key % len(TICKERS) + 1).cast("int"))


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bars(spark, sf):
    """Daily bars: symbol = market segment, price = order total."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("symbol"))
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .groupBy("symbol", F.to_date("o_orderdate").alias("ts"))
        .agg(
            F.min_by("o_totalprice", "o_orderkey").alias("open"),
            F.max("o_totalprice").alias("high"),
            F.min("o_totalprice").alias("low"),
            F.max_by("o_totalprice", "o_orderkey").alias("close"),
            F.count(F.lit(1)).alias("volume"),
        )
    )


def ticks(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", "ts", F.col("event_type").alias("symbol"), "value", (100 + F.col("value") / 120).alias("price"),
        F.regexp_extract("props", r"(\d+)", 1).cast("long").alias("size"),
    )


def bars5(spark, sf, every="5 minutes"):
    """Intraday bars: symbol = event type, size = the number in props; session is the ET date."""
    at = F.struct("ts", "event_id")
    return with_session(
        ticks(spark, sf)
        .groupBy("symbol", F.window("ts", every).start.alias("bar"))
        .agg(
            F.min_by("price", at).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", at).alias("close"),
            F.sum("size").alias("volume"),
        )
        .withColumnRenamed("bar", "ts")
    )


def with_session(df, offset_hours=4):
    """Session date and minute of the day at a fixed offset from UTC."""
    et = F.col("ts") - F.expr(f"INTERVAL {offset_hours} HOURS")
    return df.withColumn("session", F.to_date(et)).withColumn("et_minute", F.hour(et) * 60 + F.minute(et))


def anchors(n=2):
    """The two event types that stand for the market's anchor symbols."""
    return ["view", "click"][:n]


def fills(spark, sf):
    """Ordered fills: account = supplier, 20 symbols; (day, key, line, part) is a total order."""
    side = F.concat("l_returnflag", "l_linestatus")
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("account"),
        ticker(F.col("l_partkey")).alias("symbol"),
        F.col("l_quantity").cast("long").alias("qty"),
        (F.col("l_extendedprice") / (F.col("l_quantity") + 0.37)).alias("price"),
        F.when(side == "NO", "buy").when(side == "NF", "buy").when(side == "RO", "sell")
        .when(side == "AO", "short").when(side == "AF", "cover").otherwise("hold").alias("action"),
        F.to_date("l_shipdate").alias("day"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey").alias("seq"),
    )


def marks(spark, sf):
    """Latest price per symbol over all fills."""
    f = fills(spark, sf)
    return f.groupBy("symbol").agg(F.max_by("price", F.struct("seq", "account")).alias("price"))


def positions(spark, sf):
    """Net position per (account, symbol) with average entry and current mark."""
    f = fills(spark, sf)
    buy = F.col("action").isin("buy", "cover")
    signed = F.when(buy, F.col("qty")).when(F.col("action").isin("sell", "short"), -F.col("qty")).otherwise(0)
    bought = F.when(F.col("action") == "buy", F.col("qty"))
    net = f.groupBy("account", "symbol").agg(
        F.sum(signed).alias("qty"),
        F.try_divide(F.sum(bought * F.col("price")), F.sum(bought)).alias("avg_entry_price"),
    )
    pos = net.join(marks(spark, sf).withColumnRenamed("price", "current_price"), "symbol")
    sign = F.signum(F.col("qty").cast("double"))
    gain = F.col("current_price") - F.col("avg_entry_price")
    return (
        pos.withColumn("market_value", F.col("qty") * F.col("current_price"))
        .withColumn("unrealized_pl", gain * F.col("qty"))
        .withColumn("unrealized_plpc", F.try_divide(gain * sign, "avg_entry_price"))
    )


def accounts(spark, sf):
    """Cash and equity per account; last_equity is yesterday's."""
    s = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("account"), (F.abs("s_acctbal") * 1000).alias("cash"), "s_nationkey")
    held = positions(spark, sf).groupBy("account").agg(F.sum("market_value").alias("held"))
    s = s.join(held, "account", "left").withColumn("held", F.coalesce("held", F.lit(0.0)))
    return s.select(
        "account", "cash", (F.col("cash") + F.col("held")).alias("equity"),
        ((F.col("cash") + F.col("held")) * (1 + (F.col("s_nationkey") - 12) / 200)).alias("last_equity"))


def snapshots(spark, sf):
    """Daily account snapshots: account = market segment, equity compounds the day's mean order."""
    b = (
        table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus")
        .join(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_mktsegment").alias("account"), F.to_date("o_orderdate").alias("date"))
        .agg(
            F.avg(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(500000 - F.col("o_totalprice"))).alias("a"),
            F.avg("o_totalprice").alias("s"), F.max("o_totalprice").alias("q"), F.count(F.lit(1)).alias("position_count"),
        )
    )
    w = W.partitionBy("account").orderBy("date")

    def path(start, c, centre):
        return start * F.exp(F.sum((F.col(c) / centre - 1) * 0.01).over(w))

    return b.select(
        "account", "date", path(1e6, "a", 250000).alias("equity"),
        path(400, "s", 250000).alias("spy_price"), path(300, "q", 300000).alias("qqq_price"), "position_count",
    ).withColumn("cash", F.col("equity") * (F.dayofmonth("date") % 5 + 1) / 10)


def equity(spark, sf):
    return snapshots(spark, sf).select("account", "date", F.col("equity").alias("value"))


def journal(spark, sf):
    """Order journal: status, action and profit read off the order."""
    o = table(spark, sf, "orders")
    act = F.substring("o_orderpriority", 1, 1)
    action = (F.when(act == "1", "buy").when(act == "2", "sell").when(act == "3", "short")
              .when(act == "4", "cover").otherwise("hold"))
    return o.select(
        F.col("o_orderdate").alias("timestamp"),
        F.when(F.col("o_custkey") % 2 == 0, "swing").otherwise("day").alias("mode"),
        ticker(F.col("o_custkey")).alias("ticker"), action.alias("action"),
        (F.col("o_orderkey") % 100).alias("qty"),
        F.when(F.col("o_orderstatus") == "F", "executed").when(F.col("o_orderstatus") == "O", "blocked").otherwise("failed").alias("status"),
        F.when(action.isin("sell", "cover"), F.col("o_totalprice") - 250000).alias("pnl"),
        F.col("o_orderkey").alias("order_id"),
    )


def signals(spark, sf):
    """Analyst signals per day and event type, from event values."""
    e = table(spark, sf, "events").withColumn("size", F.regexp_extract("props", r"(\d+)", 1).cast("long"))
    return e.select(
        F.to_date("ts").alias("date"), F.concat(F.lit("analyst"), F.col("user_id") % 10).alias("analyst"), F.col("event_type").alias("symbol"),
        F.when(F.col("value") > 60, "bullish").when(F.col("value") < 20, "bearish").otherwise("neutral").alias("signal"),
        F.when(F.col("size") > 4, F.col("size").cast("double")).alias("confidence"), "event_id",
    )


def news(spark, sf):
    """Headlines: a document's whole text by source; its labels stand for sentiment, its number for the date."""
    d = table(spark, sf, "documents").select("doc_id", "source", "text")
    lab = table(spark, sf, "labels")
    return d.join(lab, "doc_id", "left").select(
        "doc_id", F.col("source").alias("symbol"), F.col("text").alias("title"),
        F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive")
        .when(F.col("quality") == 0, "neutral").alias("sentiment"),
        F.when(F.col("quality").isNotNull(), (F.col("doc_id") % 100).cast("double")).alias("model_confidence"),
        F.date_add(F.lit("1995-01-01").cast("date"), (F.col("doc_id") % 2500).cast("int")).alias("date"),
    )


def experiments(spark, sf):
    """Strategy experiments: a document is a hypothesis, its source the run."""
    d = table(spark, sf, "documents").select("doc_id", "source", "text", "n_chars", "lang")
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("experiment_id"), F.col("source").alias("run_id"), F.col("text").alias("hypothesis"),
        ((F.col("n_chars") % 997) / 10 - 50).alias("fitness_score"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("kept"),
        F.when(F.col("lang") == "en", "day").otherwise("swing").alias("mode"),
    )


def runs(spark, sf):
    """Run summaries from experiments, in run order."""
    e = experiments(spark, sf)
    return e.groupBy("run_id", "mode").agg(
        F.min("experiment_id").alias("started"), F.count(F.lit(1)).alias("total_experiments"),
        F.sum(F.col("kept").cast("long")).alias("keep_count"),
        F.min_by("fitness_score", "experiment_id").alias("baseline_fitness"), F.max("fitness_score").alias("best_fitness"),
    ).withColumn("improvement", F.col("best_fitness") - F.col("baseline_fitness"))


# Fundamentals per (brand, quarter). The stages are plain SQL arithmetic that Spark and the
# SQL oracle read alike; b is the brand's number and t the quarter's index.
PANEL_STAGES = [
    {
        "gr": "power(1 + (b - 8) / 200, t)",
        "wob": "rr / g - 0.333",
    },
    {"revenue": "g * gr / 1000"},
    {
        "gross_profit": "revenue * (0.2 + b / 50 + wob / 2)",
        "operating_income": "revenue * (b / 70 - 0.04 + wob)",
        "interest_expense": "revenue * (26 - b) / 1000",
        "depreciation_and_amortization": "revenue * 0.04",
        "capital_expenditure": "revenue * (0.02 + (b % 5) / 60)",
        "total_assets": "revenue * (3 + (b % 4) / 2)",
        "outstanding_shares": "1000 + 20 * b + (b % 3 - 1) * t * 3",
        "issuance_or_purchase_of_equity_shares": "(b % 3 - 1) * revenue * 0.01",
        "research_and_development": "CASE WHEN b % 7 <> 0 THEN revenue * ((b % 4) * 0.06 + wob / 20) END",
        "operating_expense": "revenue * (0.3 - b / 200 + wob / 3)",
        "market_cap": "revenue * 4 * (0.8 + ((b * 7) % 10) / 5)",
        "beta": "0.6 + (b % 10) / 10",
    },
    {
        "ebit": "operating_income",
        "ebitda": "operating_income + depreciation_and_amortization",
        "net_income": "(operating_income - interest_expense) * 0.79",
        "total_liabilities": "total_assets * (0.25 + (b % 7) / 11)",
        "current_assets": "total_assets * 0.35",
        "goodwill_and_intangible_assets": "total_assets * ((b % 5) / 8)",
    },
    {
        "operating_cash_flow": "net_income + depreciation_and_amortization + revenue * wob / 4",
        "shareholders_equity": "total_assets - total_liabilities",
        "current_liabilities": "total_liabilities * (0.2 + (b % 6) / 10)",
        "cash_and_equivalents": "current_assets * (0.2 + (b % 3) / 4)",
        "total_debt": "CASE WHEN b % 11 <> 0 THEN total_liabilities * 0.4 END",
        "earnings_per_share": "CASE WHEN b <> 13 THEN net_income / outstanding_shares END",
        "dividends_and_other_cash_distributions": "CASE WHEN b % 5 <> 0 AND net_income > 0 THEN -0.2 * net_income END",
    },
    {
        "free_cash_flow": "operating_cash_flow - capital_expenditure",
        "book_value_per_share": "shareholders_equity / outstanding_shares",
        "working_capital": "current_assets - current_liabilities",
        "gross_margin": "gross_profit / revenue",
        "operating_margin": "operating_income / revenue",
        "net_margin": "net_income / revenue",
        "return_on_equity": "net_income / nullif(shareholders_equity, 0)",
        "return_on_invested_capital": "operating_income * 0.79 / nullif(shareholders_equity + coalesce(total_debt, 0), 0)",
        "asset_turnover": "revenue / total_assets",
        "current_ratio": "current_assets / nullif(current_liabilities, 0)",
        "debt_to_equity": "total_debt / nullif(shareholders_equity, 0)",
        "interest_coverage": "ebit / nullif(interest_expense, 0)",
        "price_to_earnings_ratio": "market_cap / nullif(net_income, 0)",
        "price_to_book_ratio": "market_cap / nullif(shareholders_equity, 0)",
        "price_to_sales_ratio": "market_cap / revenue",
        "enterprise_value": "market_cap + coalesce(total_debt, 0) - cash_and_equivalents",
    },
    {
        "free_cash_flow_per_share": "free_cash_flow / outstanding_shares",
        "enterprise_value_to_ebitda_ratio": "enterprise_value / nullif(ebitda, 0)",
        "ev_to_ebit": "enterprise_value / nullif(ebit, 0)",
        **{f"{out}": f"({c} - lag({c}) OVER (PARTITION BY symbol ORDER BY report_period)) / nullif(abs(lag({c}) OVER (PARTITION BY symbol ORDER BY report_period)), 0)"
           for out, c in (("revenue_growth", "revenue"), ("earnings_growth", "net_income"), ("earnings_per_share_growth", "earnings_per_share"),
                          ("book_value_growth", "shareholders_equity"), ("free_cash_flow_growth", "free_cash_flow"))},
    },
    {"peg_ratio": "price_to_earnings_ratio / nullif(earnings_growth * 100, 0)"},
]
PANEL_ITEMS = [n for stage in PANEL_STAGES for n in stage if n not in ("gr", "wob")]


def panel(spark, sf):
    """Wide fundamentals: one row per (brand, quarter), so a brand has as many rows as quarters."""
    li = table(spark, sf, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_returnflag")
    pt = table(spark, sf, "part").select("p_partkey", "p_brand")
    p = (
        li.join(pt, li.l_partkey == pt.p_partkey)
        .groupBy(F.col("p_brand").alias("symbol"), F.trunc("l_shipdate", "quarter").alias("report_period"))
        .agg(F.round(F.sum("l_extendedprice"), 2).alias("g"),
             F.round(F.coalesce(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice"))), F.lit(0.0)), 2).alias("rr"))
        .withColumn("b", F.regexp_extract("symbol", r"(\d+)", 1).cast("double"))
        .withColumn("t", ((F.year("report_period") - 1995) * 4 + F.quarter("report_period") - 1).cast("double"))
    )
    for stage in PANEL_STAGES:
        p = p.select("*", *[F.expr(f"cast({e} as double)").alias(n) for n, e in stage.items()])
    return p.drop("g", "rr", "gr", "wob", "b", "t")


def insider(spark, sf):
    """Insider trades: sales negative, unknown share counts null."""
    li, pt = table(spark, sf, "lineitem"), table(spark, sf, "part")
    sign = F.when(F.col("l_returnflag") == "R", -1.0).when(F.col("l_returnflag") == "A", 1.0)
    return li.join(pt, li.l_partkey == pt.p_partkey).select(
        F.col("p_brand").alias("symbol"), F.to_date("l_shipdate").alias("filing_date"),
        (F.col("l_quantity") * sign).alias("transaction_shares"),
        F.when(F.col("l_linestatus") == "F", F.round("l_extendedprice", 0)).alias("transaction_value"))


def brand_news(spark, sf):
    """News keyed like the panel: source srcN belongs to Brand#N+1."""
    n = news(spark, sf)
    return n.withColumn("symbol", F.concat(F.lit("Brand#"), F.regexp_extract("symbol", r"(\d+)", 1).cast("int") + 1))


def event_news(spark, sf):
    """News keyed like the ticks: the sources go round the event types, which are few and come as one row."""
    types = table(spark, sf, "events").agg(F.sort_array(F.collect_set("event_type")).alias("_types")).scalar()
    n = news(spark, sf).withColumn("_types", types)
    turn = (F.regexp_extract("symbol", r"(\d+)", 1).cast("int") % F.size("_types")).cast("int")
    return n.withColumn("symbol", F.get("_types", turn)).drop("_types")


def brand_bars(spark, sf):
    """Daily bars per brand from unit prices."""
    li, pt = table(spark, sf, "lineitem"), table(spark, sf, "part")
    at = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    px = F.col("l_extendedprice") / (F.col("l_quantity") + 0.37)
    return li.join(pt, li.l_partkey == pt.p_partkey).groupBy(F.col("p_brand").alias("symbol"), F.to_date("l_shipdate").alias("ts")).agg(
        F.min_by(px, at).alias("open"), F.max(px).alias("high"), F.min(px).alias("low"), F.max_by(px, at).alias("close"), F.count(F.lit(1)).alias("volume"))
