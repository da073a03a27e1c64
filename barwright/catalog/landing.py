"""Registered sources, predicates, scanner and set operations.

The formats the readers take are produced from the given tables by Spark, then parsed back.
"""

from pyspark.sql import functions as F

from barwright.catalog import registry
from barwright.catalog.book import SWING, UNIVERSE
from barwright.catalog.fundamentals import AS_OF, K6, WORDS, pan
from barwright.catalog.registry import query, r, rcols, tidy
from barwright.catalog.sqlframes import BARS, BARS5, BRAND_BARS, BRAND_NEWS, BRAND_NEWS_AT, EXPERIMENTS, FILLS, INSIDER, INSIDER_AT, JOURNAL, PANEL, POSITIONS, SIGNALS, SNAPSHOTS
from barwright.catalog.aggregates import PACK, regime_case
from barwright.functions.numeric import ladder, reason, safe_div, safe_growth
from barwright.operators import aggs, joins, scanner
from barwright.plans import screens
from barwright.sources import frames, published, readers, sinks, universe
from barwright.streaming.jobs import scratch

OHLC = ("open", "high", "low", "close")


@query("s01_bars_json", f"WITH {BARS} SELECT symbol, CAST(ts AS TIMESTAMP) AS ts, open, high, low, close, volume FROM bars")
def _(spark, sf):
    b = frames.bars(spark, sf)
    rec = F.struct(F.col("symbol").alias("ticker"), *OHLC, "volume", F.date_format("ts", "yyyy-MM-dd'T00:00:00'").alias("time"))
    env = b.groupBy("symbol", F.trunc("ts", "month").alias("m")).agg(F.to_json(F.struct(F.first("symbol").alias("ticker"), F.collect_list(rec).alias("prices"))).alias("json"))
    return readers.parse_bars(env).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("s02_metrics_json", f"WITH {PANEL} SELECT symbol AS ticker, report_period, {rcols('market_cap net_margin', 4)}, {r('debt_to_equity', 4)} AS debt_to_equity FROM panel")
def _(spark, sf):
    p = pan(spark, sf)
    have = [c for c in readers.METRIC_FIELDS if c in p.columns]
    rec = F.struct(F.col("symbol").alias("ticker"), F.col("report_period").cast("string").alias("report_period"), F.lit("ttm").alias("period"), *have)
    env = p.groupBy("symbol").agg(F.to_json(F.struct(F.collect_list(rec).alias("financial_metrics"))).alias("json"))
    m = readers.parse_metrics(env)
    return tidy(m.select("ticker", "report_period", "market_cap", "net_margin", "debt_to_equity"), 4)


@query("s03_insider_json", f"WITH {INSIDER} SELECT symbol, filing_date, count(*) AS n, {r('coalesce(sum(transaction_shares), 0)', 2)} AS shares, {r('coalesce(sum(transaction_value), 0)', 2)} AS value FROM insider GROUP BY 1, 2")
def _(spark, sf):
    i = frames.insider(spark, sf)
    rec = F.struct(F.col("symbol").alias("ticker"), "transaction_shares", "transaction_value", F.col("filing_date").cast("string").alias("filing_date"))
    # one trade per envelope: no group has to fit anywhere
    p = readers.parse_insider(i.select(F.to_json(F.struct(F.array(rec).alias("insider_trades"))).alias("json")))
    g = p.groupBy(F.col("ticker").alias("symbol"), F.to_date("filing_date").alias("filing_date")).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("transaction_shares"), F.lit(0.0)).alias("shares"), F.coalesce(F.sum("transaction_value"), F.lit(0.0)).alias("value"))
    return tidy(g, 2)


@query("s04_normalize_news", """WITH d AS (SELECT doc_id, source, text, CAST(TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * doc_id AS TIMESTAMP) AS pub FROM documents)
  SELECT 'T' || source AS symbol, text AS title, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'p' || source END AS source, 'u' || doc_id AS url, strftime(pub, '%Y-%m-%dT%H:%M:%SZ') AS date
  FROM d WHERE doc_id % 5 <> 0 AND CAST(pub AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-02-05'""")
def _(spark, sf):
    d = frames.table(spark, sf, "documents")
    title = F.when(F.col("doc_id") % 5 != 0, F.col("text")).otherwise("")
    iso = F.date_format(F.expr("timestampadd(HOUR, cast(doc_id as int), timestamp_ntz'2024-01-01 00:00:00')"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    flat = F.to_json(F.struct(F.concat(F.lit("T"), "source").alias("ticker"), title.alias("title"), F.col("source").alias("publisher"),
                              F.concat(F.lit("u"), "doc_id").alias("link"), F.struct(iso.alias("pubDate")).alias("content")))
    nested = F.to_json(F.struct(F.concat(F.lit("T"), "source").alias("ticker"), F.lit("").alias("title"), F.struct(
        title.alias("title"), iso.alias("pubDate"), F.struct(F.concat(F.lit("p"), "source").alias("displayName")).alias("provider"),
        F.struct(F.concat(F.lit("u"), "doc_id").alias("url")).alias("canonicalUrl")).alias("content")))
    raw = d.select(F.from_json(F.when(F.col("doc_id") % 2 == 0, flat).otherwise(nested), readers.NEWS).alias("j")).select("j.*")
    return readers.normalize_news(raw, "2024-01-05", "2024-02-05")


def facts(spark, sf):
    """Company-facts JSON per brand: odd quarters are 10-Q, the fourth is 10-K, one concept has two names."""
    p = pan(spark, sf)
    end = F.col("report_period").cast("string")
    form = F.when(F.quarter("report_period") == 4, "10-K").when(F.quarter("report_period") == 2, "8-K").otherwise("10-Q")

    def obs(c):
        return F.filter(F.collect_list(F.struct(F.col(c).alias("val"), end.alias("end"), end.alias("filed"), form.alias("form"))), lambda x: x["val"].isNotNull())

    g = p.groupBy("symbol").agg(*[obs(c).alias(c) for c in ("revenue", "net_income", "total_assets", "shareholders_equity", "total_debt", "operating_cash_flow", "capital_expenditure")])
    odd = F.regexp_extract("symbol", r"(\d+)", 1).cast("int") % 2 == 1

    def usd(c):
        return F.struct(F.create_map(F.lit("USD"), F.col(c)).alias("units"))

    concepts = F.map_from_arrays(
        F.array(F.when(odd, "Revenues").otherwise("SalesRevenueNet"), F.lit("NetIncomeLoss"), F.lit("Assets"), F.lit("StockholdersEquity"), F.lit("LongTermDebt"),
                F.lit("NetCashProvidedByUsedInOperatingActivities"), F.lit("PaymentsToAcquirePropertyPlantAndEquipment")),
        F.array(*[usd(c) for c in ("revenue", "net_income", "total_assets", "shareholders_equity", "total_debt", "operating_cash_flow", "capital_expenditure")]))
    return g.select("symbol", F.to_json(F.struct(F.create_map(F.lit("us-gaap"), concepts).alias("facts"))).alias("json"))


@query("s05_flatten_xbrl", f"""WITH {PANEL}, f AS (SELECT * FROM panel WHERE quarter(report_period) <> 2), c AS (
    SELECT symbol, 'Assets' AS concept, report_period, total_assets AS val FROM f UNION ALL SELECT symbol, 'NetIncomeLoss', report_period, net_income FROM f
    UNION ALL SELECT symbol, 'LongTermDebt', report_period, total_debt FROM f UNION ALL SELECT symbol, CASE WHEN CAST(b AS BIGINT) % 2 = 1 THEN 'Revenues' ELSE 'SalesRevenueNet' END, report_period, revenue FROM f
    UNION ALL SELECT symbol, 'StockholdersEquity', report_period, shareholders_equity FROM f UNION ALL SELECT symbol, 'NetCashProvidedByUsedInOperatingActivities', report_period, operating_cash_flow FROM f
    UNION ALL SELECT symbol, 'PaymentsToAcquirePropertyPlantAndEquipment', report_period, capital_expenditure FROM f)
  SELECT symbol, concept, report_period AS "end", {r('val', 2)} AS val, CASE WHEN quarter(report_period) = 4 THEN '10-K' ELSE '10-Q' END AS form FROM c WHERE val IS NOT NULL""")
def _(spark, sf):
    o = readers.flatten_xbrl(facts(spark, sf), "quarterly")
    return o.select("symbol", "concept", F.to_date("end").alias("end"), F.round("val", 2).alias("val"), "form")


ITEMS = ["revenue", "net_income", "total_assets", "shareholders_equity", "total_debt", "free_cash_flow"]
LAST6 = f"""WITH {PANEL}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY report_period DESC) AS rn FROM panel WHERE quarter(report_period) <> 2 AND report_period <= DATE '2001-06-30'), l AS (SELECT * FROM k WHERE rn <= 6)"""


def line_items(spark, sf):
    return readers.extract_line_items(readers.flatten_xbrl(facts(spark, sf), "quarterly"), ITEMS, "2001-06-30", 6)


@query("s06_line_items", f"{LAST6} SELECT symbol, report_period, {rcols(' '.join(ITEMS[:-1]), 2)}, {r('operating_cash_flow - capital_expenditure', 2)} AS free_cash_flow FROM l")
def _(spark, sf):
    return tidy(line_items(spark, sf), 2)


@query("s07_historical_ratios", f"""{LAST6} SELECT symbol, report_period, {r('net_income / revenue', 4)} AS operating_margin, {r('net_income / revenue', 4)} AS net_margin, {r('net_income / shareholders_equity', 4)} AS return_on_equity,
  {r('net_income / total_assets', 4)} AS return_on_assets, {r('revenue / total_assets', 4)} AS asset_turnover, {r('total_debt / shareholders_equity', 4)} AS debt_to_equity, {r('total_debt / total_assets', 4)} AS debt_to_assets FROM l""")
def _(spark, sf):
    return tidy(readers.historical_ratios(line_items(spark, sf)), 4)


NAMES = {"revenue": ["revenue"], "cogs": ["operating_expense"], "ebit": ["ebit", "operating_income"], "net_income": ["net_income"], "interest_expense": ["interest_expense"],
         "operating_income": ["operating_income", "ebit"], "ebitda": ["ebitda"], "total_assets": ["total_assets"], "current_assets": ["current_assets"],
         "current_liabilities": ["current_liabilities"], "inventory": ["research_and_development", "capital_expenditure"], "receivables": ["working_capital"], "cash": ["cash_and_equivalents"],
         "total_debt": ["total_debt"], "operating_cash_flow": ["operating_cash_flow"], "free_cash_flow": ["free_cash_flow"]}
_g = lambda c: f"({c} - lag({c}) OVER w) / nullif(abs(lag({c}) OVER w), 0)"


@query("s08_statement_ratios", f"""WITH {PANEL}, d AS (SELECT *, coalesce(research_and_development, capital_expenditure) AS inv FROM panel) SELECT symbol, report_period,
  {r('ebit / nullif(total_assets - current_liabilities, 0)', 4)} AS return_on_invested_capital, {r('operating_expense / nullif(inv, 0)', 4)} AS inventory_turnover, {r('365 / nullif(revenue / nullif(working_capital, 0), 0)', 4)} AS days_sales_outstanding,
  {r('365 / nullif(operating_expense / nullif(inv, 0), 0) + 365 / nullif(revenue / nullif(working_capital, 0), 0)', 4)} AS operating_cycle, {r('revenue / nullif(current_assets - current_liabilities, 0)', 4)} AS working_capital_turnover,
  {r('ebit / abs(nullif(interest_expense, 0))', 4)} AS interest_coverage, {r(_g('net_income'), 4)} AS net_income_growth, {r(_g('ebitda'), 4)} AS ebitda_growth FROM d WINDOW w AS (PARTITION BY symbol ORDER BY report_period)""")
def _(spark, sf):
    s = readers.statement_ratios(pan(spark, sf), NAMES)
    return tidy(s.select("symbol", "report_period", "return_on_invested_capital", "inventory_turnover", "days_sales_outstanding", "operating_cycle", "working_capital_turnover", "interest_coverage", "net_income_growth", "ebitda_growth"), 4)


@query("s09_explode_filings", """WITH f AS (SELECT l_orderkey AS symbol, CASE l_returnflag WHEN 'A' THEN '4' WHEN 'N' THEN '4/A' ELSE '10-K' END AS form, strftime(l_shipdate, '%Y-%m-%d') AS "filingDate",
    'acc' || l_partkey AS "accessionNumber", row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) - 1 AS pos FROM lineitem),
  k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY pos) AS rn FROM f WHERE form IN ('4', '4/A') AND "filingDate" BETWEEN '1996-01-01' AND '2000-12-31') SELECT symbol, pos, form, "filingDate", "accessionNumber" FROM k WHERE rn <= 2""")
def _(spark, sf):
    li = frames.table(spark, sf, "lineitem")
    form = F.when(F.col("l_returnflag") == "A", "4").when(F.col("l_returnflag") == "N", "4/A").otherwise("10-K")
    rec = F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", form.alias("form"))
    idx = li.groupBy(F.col("l_orderkey").alias("symbol")).agg(F.sort_array(F.collect_list(rec)).alias("a"))
    idx = idx.select("symbol", F.transform("a", lambda x: x["form"]).alias("form"), F.transform("a", lambda x: F.date_format(x["l_shipdate"], "yyyy-MM-dd")).alias("filingDate"),
                     F.transform("a", lambda x: F.concat(F.lit("acc"), x["l_partkey"])).alias("accessionNumber"))
    return tidy(readers.explode_filings(idx, "1996-01-01", "2000-12-31", 2))


@query("s10_form4_xml", """SELECT 'S' || (l_partkey % 20) AS symbol, 'owner ' || l_suppkey AS name, l_linenumber % 2 = 0 AS is_board_director, CAST(l_shipdate AS DATE) AS transaction_date,
  CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS transaction_shares, round(abs(l_quantity * l_extendedprice), 2) + 0.0 AS transaction_value, l_quantity * 2 AS shares_owned_after_transaction FROM lineitem""")
def _(spark, sf):
    li = frames.table(spark, sf, "lineitem")
    xml = F.format_string(
        "<ownershipDocument><issuer><issuerTradingSymbol>S%d</issuerTradingSymbol></issuer><reportingOwner><reportingOwnerId><rptOwnerName>owner %d</rptOwnerName></reportingOwnerId>"
        "<reportingOwnerRelationship><isDirector>%d</isDirector></reportingOwnerRelationship></reportingOwner><nonDerivativeTable><nonDerivativeTransaction><securityTitle><value>Common</value></securityTitle>"
        "<transactionDate><value>%s</value></transactionDate><transactionAmounts><transactionShares><value>%s</value></transactionShares><transactionPricePerShare><value>%s</value></transactionPricePerShare>"
        "<transactionAcquiredDisposedCode><value>%s</value></transactionAcquiredDisposedCode></transactionAmounts><postTransactionAmounts><sharesOwnedFollowingTransaction><value>%s</value>"
        "</sharesOwnedFollowingTransaction></postTransactionAmounts></nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>",
        F.col("l_partkey") % 20, F.col("l_suppkey"), F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(0), F.date_format("l_shipdate", "yyyy-MM-dd"), F.col("l_quantity").cast("string"),
        F.col("l_extendedprice").cast("string"), F.when(F.col("l_returnflag") == "R", "D").otherwise("A"), (F.col("l_quantity") * 2).cast("string"))
    t = readers.parse_form4(li.select(xml.alias("xml")))
    return tidy(t.select("symbol", "name", "is_board_director", "transaction_date", "transaction_shares", "transaction_value", "shares_owned_after_transaction"), 2)


@query("s11_bar_arrays", f"WITH {BARS5} SELECT symbol, ts, {rcols('open high low close')}, CASE WHEN volume % 3 = 0 THEN 0.0::DOUBLE ELSE volume::DOUBLE END AS volume FROM bars5")
def _(spark, sf):
    b = frames.bars5(spark, sf)
    rec = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"),
                   F.when(F.col("volume") % 3 != 0, F.col("volume").cast("double")).alias("v"))
    arr = b.groupBy("symbol", "session").agg(F.to_json(F.collect_list(rec)).alias("json"))
    return tidy(readers.parse_bar_arrays(arr).withColumn("ts", F.col("ts").cast("timestamp_ntz")))


JLINE = "order_id % 10 <> 0 AND ticker = 'NVDA' AND timestamp >= TIMESTAMP '1997-01-01'"


@query("s12_journal", f"WITH {JOURNAL} SELECT strftime(timestamp, '%Y-%m-%d') AS timestamp, ticker, action, status, CAST(order_id AS VARCHAR) AS order_id FROM journal WHERE {JLINE} ORDER BY timestamp DESC, CAST(order_id AS VARCHAR) DESC LIMIT 100")
def _(spark, sf):
    j = frames.journal(spark, sf)
    line = F.to_json(F.struct(F.date_format("timestamp", "yyyy-MM-dd").alias("timestamp"), "mode", "ticker", "action", "qty", "status", F.col("order_id").cast("string").alias("order_id")))
    lines = j.select(F.when(F.col("order_id") % 10 == 0, F.substring(line, 1, 25)).otherwise(line).alias("line"))
    return readers.parse_journal(lines, ticker="nvda", since="1997-01-01", limit=100).select("timestamp", "ticker", "action", "status", "order_id")


@query("s13_journal_rows", f"WITH {JOURNAL} SELECT mode, ticker, action, qty, status, CAST(order_id AS VARCHAR) AS order_id FROM journal WHERE status <> 'failed'")
def _(spark, sf):
    j = frames.journal(spark, sf).withColumn("status", F.when(F.col("status") == "failed", "skipped").otherwise(F.col("status")))
    return sinks.journal_rows(j).select("mode", "ticker", "action", "qty", "status", F.col("order_id").cast("string").alias("order_id"))


for _force in (False, True):
    @query("s14_snapshots_" + ("force" if _force else "keep"), f"""WITH {SNAPSHOTS}, o AS (SELECT account, date, position_count AS n FROM snapshots WHERE date <= DATE '1998-12-31'), w AS (SELECT account, date, position_count + 100 AS n FROM snapshots WHERE date >= DATE '1998-06-01')
      SELECT account, date, {'coalesce(w.n, o.n)' if _force else 'coalesce(o.n, w.n)'} AS position_count FROM o FULL JOIN w USING (account, date)""")
    def _(spark, sf, force=_force):
        s = frames.snapshots(spark, sf).select("account", "date", "position_count")
        old = s.filter(F.col("date") <= F.lit("1998-12-31").cast("date"))
        new = s.filter(F.col("date") >= F.lit("1998-06-01").cast("date")).withColumn("position_count", F.col("position_count") + 100)
        return tidy(sinks.merge_snapshots(old, new, force))


@query("s14_snapshot_writer", f"""WITH {SNAPSHOTS} SELECT account, date, CASE WHEN account = 'BUILDING' AND date >= DATE '2000-01-01' THEN position_count + 1000
    WHEN account > 'C' OR date <= DATE '1998-12-31' THEN position_count + CASE WHEN date > DATE '1998-12-31' THEN 100 ELSE 0 END ELSE position_count + 100 END AS position_count FROM snapshots""")
def _(spark, sf):
    """First days, then later ones that overlap and must not replace, then one account's last days by force; read back from the folder."""
    s, path = frames.snapshots(spark, sf).select("account", "date", "position_count"), scratch(spark, "s14")
    at, n = F.col("date"), F.col("position_count")
    sinks.write_snapshots(s.filter(at <= F.lit("1998-12-31").cast("date")), path)
    sinks.write_snapshots(s.filter(at >= F.lit("1998-06-01").cast("date")).withColumn("position_count", n + 100), path)
    sinks.write_snapshots(s.filter((F.col("account") == "BUILDING") & (at >= F.lit("2000-01-01").cast("date"))).withColumn("position_count", n + 1000), path, force=True)
    return tidy(readers.read_snapshots(spark, path).select("account", "date", "position_count"))


@query("s14_snapshots_published", registry.ORACLES["s14_snapshot_writer"])
def _(spark, sf):
    """The same three writes as published batches, each handed in twice, one of them after an attempt that was never published."""
    s, path = frames.snapshots(spark, sf).select("account", "date", "position_count"), scratch(spark, "s14-published")
    at, n, schema = F.col("date"), F.col("position_count"), s.schema
    runs = [("first", s.filter(at <= F.lit("1998-12-31").cast("date")), False),
            ("later", s.filter(at >= F.lit("1998-06-01").cast("date")).withColumn("position_count", n + 100), False),
            ("force", s.filter((F.col("account") == "BUILDING") & (at >= F.lit("2000-01-01").cast("date"))).withColumn("position_count", n + 1000), True)]
    s.withColumn("part", F.trunc("date", "month").cast("string")).write.partitionBy("part").parquet(f"{path}/data/attempt=first-died")
    for batch, rows, force in runs:
        for _again in range(2):
            published.snapshots_once(rows, path, batch, schema, force)
    return tidy(published.read_published(spark, path, schema))


@query("s16_append_once", registry.ORACLES["s13_journal_rows"])
def _(spark, sf):
    """The journal appended in two batches, one of them twice."""
    path = scratch(spark, "s16-published")
    j = sinks.journal_rows(frames.journal(spark, sf).withColumn("status", F.when(F.col("status") == "failed", "skipped").otherwise(F.col("status"))))
    odd = F.crc32(F.col("order_id").cast("string")) % 2 == 1
    for batch, rows in (("even", j.where(~F.coalesce(odd, F.lit(False)))), ("odd", j.where(odd)), ("even", j.where(~F.coalesce(odd, F.lit(False))))):
        published.journal_once(rows, path, batch)
    back = published.read_published(spark, path, j.schema)
    return back.select("mode", "ticker", "action", "qty", "status", F.col("order_id").cast("string").alias("order_id"))


@query("s15_read_snapshots", f"""WITH {SNAPSHOTS} SELECT account, date, {r('equity', 2)} AS equity FROM snapshots WHERE date >= DATE '2000-01-01'""")
def _(spark, sf):
    path = scratch(spark, "s15")
    sinks.write_snapshots(frames.snapshots(spark, sf), path)
    return tidy(readers.read_snapshots(spark, path, "2000-01-01").select("account", "date", "equity"), 2)


@query("s16_append_json", f"""WITH {POSITIONS} SELECT account, symbol, {r('unrealized_plpc')} AS plpc, 2::BIGINT AS times FROM positions WHERE abs(unrealized_plpc * 100) > 5""")
def _(spark, sf):
    """The alert log after two runs: every record twice, all stamped."""
    path, found = scratch(spark, "s16"), scratch(spark, "s16-alerts")
    # kept once for both runs: computed again, sums of doubles may differ in their last digits
    scanner_alerts(spark, sf).write.parquet(found)
    alerts = spark.read.parquet(found)
    for _run in range(2):
        sinks.append_json(alerts, path)
    log = spark.read.schema("account long, symbol string, plpc double, timestamp string").json(path)
    return tidy(log.filter(F.col("timestamp").isNotNull()).groupBy("account", "symbol", "plpc").agg(F.count(F.lit(1)).alias("times")))


def scanner_alerts(spark, sf):
    from barwright.operators import risk
    return risk.big_movers(frames.positions(spark, sf)).select("account", "symbol", F.col("unrealized_plpc").alias("plpc"))


@query("s17_read_experiments", f"""WITH {EXPERIMENTS} SELECT experiment_id::VARCHAR AS experiment_id, mode, kept, {r('fitness_score')} AS fitness_score, {r('fitness_score / 10')} AS sharpe, length(hypothesis) AS chars FROM experiments""")
def _(spark, sf):
    """Experiments written as JSON lines, a broken line among them, and read back."""
    path = scratch(spark, "s17")
    e = frames.experiments(spark, sf).select(
        F.col("experiment_id").cast("string").alias("experiment_id"), "mode", "hypothesis", "kept", "fitness_score", F.create_map(F.lit("sharpe_ratio"), F.col("fitness_score") / 10).alias("metrics"))
    e.write.json(path)
    e.limit(1).select(F.lit("{ not json").alias("value")).write.mode("append").text(path)
    x = readers.read_experiments(spark, path)
    return tidy(x.select("experiment_id", "mode", "kept", "fitness_score", F.col("metrics")["sharpe_ratio"].alias("sharpe"), F.char_length("hypothesis").cast("long").alias("chars")))


@query("s18_universe", f"""WITH {FILLS}, {UNIVERSE} SELECT mode, sector, symbol, count(*) AS fills, CAST(sum(qty) AS BIGINT) AS qty FROM uni JOIN fills USING (symbol) GROUP BY 1, 2, 3""")
def _(spark, sf):
    j = frames.fills(spark, sf).join(F.broadcast(universe.universe_df(spark).select("mode", "sector", "symbol")), "symbol")
    return tidy(j.groupBy("mode", "sector", "symbol").agg(F.count(F.lit(1)).alias("fills"), F.sum("qty").alias("qty")))


@query("s19_merge_keep_existing", f"""WITH {BARS}, o AS (SELECT symbol, ts, close FROM bars WHERE ts <= DATE '1998-12-31'), n AS (SELECT symbol, ts, close + 1 AS close FROM bars WHERE ts >= DATE '1998-06-01')
  SELECT * FROM o UNION ALL SELECT * FROM n ANTI JOIN o USING (symbol, ts)""")
def _(spark, sf):
    b = frames.bars(spark, sf).select("symbol", "ts", "close")
    new = b.filter(F.col("ts") >= F.lit("1998-06-01").cast("date")).withColumn("close", F.col("close") + 1)
    return sinks.merge_keep_existing(b.filter(F.col("ts") <= F.lit("1998-12-31").cast("date")), new, ("symbol", "ts"))


@query("s20_company_facts", """WITH i AS (SELECT c_custkey AS symbol, CASE WHEN c_custkey % 2 = 0 THEN c_name WHEN c_custkey % 3 = 0 THEN '' END AS long_name, CASE WHEN c_custkey % 5 = 0 THEN 'short ' || c_custkey END AS short_name, c_mktsegment AS sector FROM customer),
  g AS (SELECT s_suppkey AS symbol, s_name AS name, s_nationkey AS sic_code FROM supplier)
  SELECT CAST(symbol AS VARCHAR) AS symbol, coalesce(nullif(long_name, ''), nullif(short_name, ''), nullif(name, ''), CAST(symbol AS VARCHAR)) AS name, sector, CAST(sic_code AS BIGINT) AS sic_code FROM i FULL JOIN g USING (symbol)""")
def _(spark, sf):
    c, s = frames.table(spark, sf, "customer"), frames.table(spark, sf, "supplier")
    k = F.col("c_custkey")
    info = c.select(k.cast("string").alias("symbol"), F.when(k % 2 == 0, F.col("c_name")).when(k % 3 == 0, "").alias("long_name"),
                    F.when(k % 5 == 0, F.concat(F.lit("short "), k)).alias("short_name"), F.col("c_mktsegment").alias("sector"), F.lit(None).cast("string").alias("industry"), F.lit(None).cast("string").alias("exchange"))
    reg = s.select(F.col("s_suppkey").cast("string").alias("symbol"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("sic_code"))
    return tidy(readers.company_facts(info, reg).drop("industry", "exchange"))


# -- predicates and scalars -------------------------------------------------------------

@query("p01_coerce_bars", """SELECT CAST(o_custkey AS VARCHAR) AS symbol, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END AS ts, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS close FROM orders""")
def _(spark, sf):
    o = frames.table(spark, sf, "orders")
    px = F.col("o_totalprice").cast("string")
    t = o.select(F.col("o_custkey").cast("string").alias("symbol"), F.when(F.col("o_orderkey") % 7 == 0, "not a time").otherwise(F.col("o_orderdate").cast("string")).alias("time"),
                 px.alias("open"), px.alias("high"), px.alias("low"), F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(px).alias("close"), F.lit("1").alias("volume"))
    return readers.coerce_bars(t).select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "close")


@query("p02_between_dates", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1997-03-01' AND DATE '1997-06-30'")
def _(spark, sf):
    li = readers.between_dates(frames.table(spark, sf, "lineitem"), "1997-03-01", "1997-06-30", "l_shipdate")
    return tidy(li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("day")))


SYM = "upper(replace(substr(p_name, 1, CAST(p_size % 7 AS INT)), ' ', ''))"


@query("p06_eligible_symbol", f"""WITH s AS (SELECT p_partkey, {SYM} AS symbol FROM part) SELECT p_partkey, symbol, length(symbol) BETWEEN 1 AND 5 AND NOT (length(symbol) > 3 AND right(symbol, 1) IN ('W', 'U', 'R'))
  AND symbol NOT IN ({', '.join(f"'{x}'" for x in scanner.EXCLUDE)}) AS eligible FROM s""")
def _(spark, sf):
    s = frames.table(spark, sf, "part").select("p_partkey", F.expr(SYM).alias("symbol"))
    return s.withColumn("eligible", scanner.eligible_symbol("symbol"))


@query("p07_safe_math", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {r('l_tax / nullif(l_discount, 0)')} AS ratio, {r('(l_tax - l_discount) / nullif(abs(l_discount), 0)')} AS growth FROM lineitem""")
def _(spark, sf):
    li = frames.table(spark, sf, "lineitem")
    return tidy(li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", safe_div("l_tax", "l_discount").alias("ratio"), safe_growth("l_tax", "l_discount").alias("growth")))


@query("p10_label_maps", f"""WITH {BRAND_NEWS} SELECT doc_id, CASE sentiment WHEN 'negative' THEN 'bearish' WHEN 'positive' THEN 'bullish' ELSE 'neutral' END AS signal,
  CASE sentiment WHEN 'negative' THEN -1 WHEN 'positive' THEN 1 ELSE 0 END::BIGINT AS value FROM news""")
def _(spark, sf):
    from barwright.functions.labels import map_sentiment, signal_value
    n = frames.news(spark, sf)
    return tidy(n.select("doc_id", map_sentiment("sentiment").alias("signal")).withColumn("value", signal_value("signal")))


@query("p12_parse_decisions", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS action, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 50 END AS quantity FROM orders""")
def _(spark, sf):
    o = frames.table(spark, sf, "orders")
    js = F.to_json(F.struct(F.col("o_orderpriority").alias("action"), (F.col("o_orderkey") % 50).alias("quantity")))
    d = readers.parse_decisions(o.select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, F.lit("{broken")).otherwise(js).alias("t")), "t", "action string, quantity long")
    return d.select("o_orderkey", "decision.action", "decision.quantity")


@query("f07_ladder", "SELECT p_partkey, CASE WHEN p_size > 40 THEN 3 WHEN p_size > 20 THEN 2 WHEN p_size > 5 THEN 1 ELSE 0 END::DOUBLE AS points FROM part")
def _(spark, sf):
    return frames.table(spark, sf, "part").select("p_partkey", ladder("p_size", [(40, 3.0), (20, 2.0), (5, 1.0)]).alias("points"))


@query("f08_reason", """SELECT p_partkey, concat_ws('; ', CASE WHEN p_size > 25 THEN 'large ' || p_size END, CASE WHEN p_retailprice > 1000 THEN 'dear' END, CASE WHEN p_type = 'ECONOMY' THEN 'economy' END) AS reason FROM part""")
def _(spark, sf):
    p = frames.table(spark, sf, "part")
    return p.select("p_partkey", reason(F.when(F.col("p_size") > 25, F.concat(F.lit("large "), "p_size")), F.when(F.col("p_retailprice") > 1000, "dear"), F.when(F.col("p_type") == "ECONOMY", "economy")).alias("reason"))


# -- scanner and sets -------------------------------------------------------------------

KEY = "concat(chr(65 + k % 26), chr(65 + floor(k / 26) % 26), chr(65 + floor(k / 676) % 26), CASE WHEN k % 11 = 0 THEN 'W' ELSE '' END)"
SCAN = f"""sc AS (SELECT l_partkey AS k, count(*) AS n, round(avg(l_discount) * 1000 - 50, 4) AS chg, sum(l_quantity) AS vol FROM lineitem GROUP BY 1),
  pr AS (SELECT {KEY.replace('floor(', 'CAST(floor(').replace(') % 26', ') AS INT) % 26').replace('chr(65 + k % 26)', 'chr(CAST(65 + k % 26 AS INT))')} AS symbol, k, n, chg, vol, p_retailprice / 100 AS price FROM sc JOIN part ON p_partkey = k),
  el AS (SELECT *, length(symbol) BETWEEN 1 AND 5 AND NOT (length(symbol) > 3 AND right(symbol, 1) IN ('W', 'U', 'R')) AND symbol NOT IN ({', '.join(f"'{x}'" for x in scanner.EXCLUDE)}) AS ok FROM pr),
  mv AS (SELECT symbol, CASE WHEN chg < -5 OR chg > 12 THEN 'loser' ELSE 'gainer' END AS source, price, round_even(chg, 2) AS change_pct FROM el WHERE ok AND price >= 10 AND abs(chg) < 40 AND (chg > 5 OR chg < -5)),
  ac AS (SELECT symbol, n * 1000 AS trade_count, CAST(vol AS BIGINT) AS volume FROM el WHERE ok AND n * 1000 >= 5000 AND n % 2 = 0),
  mm AS (SELECT symbol, CASE WHEN source IS NULL THEN 'active' WHEN trade_count IS NOT NULL THEN source || '+active' ELSE source END AS source, coalesce(mv.price, s.px) AS price, change_pct, trade_count, volume
    FROM mv FULL JOIN ac USING (symbol) LEFT JOIN (SELECT symbol, CASE WHEN k % 2 = 0 THEN price + 1 ELSE price - 1 END AS px FROM el) s USING (symbol)),
  movers AS (SELECT * FROM mm WHERE price >= 10)"""


def movers(spark, sf):
    li, pt = frames.table(spark, sf, "lineitem"), frames.table(spark, sf, "part")
    g = li.groupBy(F.col("l_partkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_discount") * 1000 - 50, 4).alias("percent_change"), F.sum("l_quantity").alias("vol"))
    g = g.join(pt, F.col("k") == pt.p_partkey).select(F.expr(KEY).alias("symbol"), "k", "n", "percent_change", "vol", (F.col("p_retailprice") / 100).alias("price"))
    chg = F.col("percent_change")
    gain, lose = g.filter(chg > 5), g.filter((chg < -5) | (chg > 12))
    act = g.filter(F.col("n") % 2 == 0).select("symbol", (F.col("n") * 1000).alias("trade_count"), F.col("vol").cast("long").alias("volume"))
    snaps = g.select("symbol", F.when(F.col("k") % 2 == 0, F.col("price") + 1).alias("trade_price"), (F.col("price") - 1).alias("daily_close"))
    return scanner.merge_movers(gain, lose, act, snaps)


@query("j10_merge_movers", f"WITH {SCAN} SELECT symbol, source, {r('price', 4)} AS price, {r('change_pct', 2)} AS change_pct, trade_count, volume FROM movers")
def _(spark, sf):
    return movers(spark, sf).withColumn("price", F.round("price", 4)).withColumn("change_pct", F.round("change_pct", 2))


_core = ", ".join(f"('{s}', {i + 1})" for i, s in enumerate(scanner.CORE))


@query("t01_rank_candidates", f"""WITH {SCAN}, core(symbol, rank) AS (VALUES {_core}), s AS (SELECT symbol, source, CASE WHEN contains(source, '+') THEN 100 ELSE 0 END + CASE WHEN source LIKE '%gainer%' OR source LIKE '%loser%' THEN 50 ELSE 0 END
    + least(coalesce(trade_count, 0) / 10000, 50) AS score FROM movers WHERE symbol NOT IN (SELECT symbol FROM core)),
  k AS (SELECT *, row_number() OVER (ORDER BY score DESC, symbol) AS rn FROM s) SELECT symbol, 'core' AS source, NULL::DOUBLE AS score, rank::BIGINT AS rank FROM core
  UNION ALL SELECT symbol, source, {r('score', 4)}, rn + 11 FROM k WHERE rn <= 14""")
def _(spark, sf):
    return tidy(scanner.rank_candidates(movers(spark, sf)), 4)


@query("t03_top_n", f"WITH {POSITIONS} SELECT account, symbol, {r('abs(market_value)', 2)} AS size FROM positions ORDER BY abs(market_value) DESC, account, symbol LIMIT 25")
def _(spark, sf):
    p = frames.positions(spark, sf).select("account", "symbol", F.abs("market_value").alias("size"))
    return tidy(scanner.top_n(p, "size", 25, "account"), 2)


@query("t04_ordered_signals", f"WITH {SIGNALS} SELECT event_id, analyst, CASE analyst WHEN 'analyst3' THEN 0 WHEN 'analyst1' THEN 1 ELSE 2 END::BIGINT AS position FROM signals")
def _(spark, sf):
    return tidy(scanner.ordered_signals(frames.signals(spark, sf), ["analyst3", "analyst1"]).select("event_id", "analyst", "position"))


@query("u01_watchlist", f"""WITH {POSITIONS}, {SWING}, w AS (SELECT symbol, 0 AS p FROM positions WHERE qty <> 0 UNION ALL SELECT symbol, 1 FROM u UNION ALL SELECT unnest(['SPY', 'QQQ']), 2)
  SELECT symbol, min(p)::BIGINT AS priority FROM w GROUP BY 1""")
def _(spark, sf):
    held = frames.positions(spark, sf).filter(F.col("qty") != 0)
    anchors = spark.createDataFrame([("SPY",), ("QQQ",)], "symbol string")
    return tidy(scanner.watchlist(held, universe.universe_df(spark, "swing"), anchors))


@query("u02_risk_universe", f"WITH {FILLS}, {JOURNAL} SELECT DISTINCT symbol FROM (SELECT symbol FROM fills UNION ALL SELECT ticker FROM journal WHERE status = 'executed')")
def _(spark, sf):
    j = frames.journal(spark, sf).filter(F.col("status") == "executed").select(F.col("ticker").alias("symbol"))
    return scanner.risk_universe(frames.fills(spark, sf), j)


@query("u04_universe_symbols", f"WITH {FILLS}, {SWING} SELECT DISTINCT symbol FROM u SEMI JOIN fills USING (symbol)")
def _(spark, sf):
    return universe.universe_symbols(spark, "swing").join(frames.fills(spark, sf).select("symbol"), "symbol", "left_semi")


# -- briefs -----------------------------------------------------------------------------

BRIEF = f"""WITH {PANEL}, {INSIDER_AT}, {BRAND_NEWS_AT}, {BRAND_BARS}, {PACK.replace('FROM bars)', 'FROM brand_bars)')},
  ch AS (SELECT symbol, (c1 - c2) / c2 * 100 AS d1, (c1 - c5) / c5 * 100 AS d5, (c1 - c30) / c30 * 100 AS d30, volume, v10 FROM pack),
  fu AS (SELECT symbol, arg_max(revenue_growth, report_period) AS rg, arg_max(price_to_earnings_ratio, report_period) AS pe FROM panel GROUP BY 1),
  j AS (SELECT ch.*, rg, pe, coalesce(buys > sells, false) AS buying, symbol IN (SELECT symbol FROM brand_news) AS nw FROM ch LEFT JOIN flow USING (symbol) LEFT JOIN fu USING (symbol))"""


def pack(spark, sf):
    return aggs.return_pack(frames.brand_bars(spark, sf))


@query("k18_momentum_brief", f"""{BRIEF} SELECT symbol, CASE WHEN d5 > 5 AND d30 > 10 THEN 'bullish' WHEN d5 < -5 AND d30 < -10 THEN 'bearish' ELSE 'neutral' END AS signal,
  {r('CASE WHEN (d5 > 5 AND d30 > 10) OR (d5 < -5 AND d30 < -10) THEN least(0.9, 0.5 + abs(d5) / 50) ELSE 0.5 END', 4)} AS confidence, CASE WHEN buying THEN 'insider' WHEN nw THEN 'news' ELSE 'momentum' END AS catalyst,
  coalesce(nullif(concat_ws('; ', CASE WHEN abs(d1) > 3 THEN CASE WHEN d1 > 0 THEN 'up ' ELSE 'down ' END || printf('%.1f', abs(d1)) || '% today' END, CASE WHEN abs(d5) > 5 THEN CASE WHEN d5 > 0 THEN 'up ' ELSE 'down ' END || printf('%.1f', abs(d5)) || '% this week' END,
    CASE WHEN rg > 0.2 THEN 'rev growth ' || printf('%.0f', rg * 100) || '%' END, CASE WHEN pe <> 0 AND pe < 15 THEN 'PE ' || printf('%.1f', pe) END), ''), 'steady') AS reason FROM j""")
def _(spark, sf):
    fu = pan(spark, sf).groupBy("symbol").agg(F.max_by("revenue_growth", "report_period").alias("revenue_growth"), F.max_by("price_to_earnings_ratio", "report_period").alias("pe_ratio"))
    return tidy(screens.momentum_brief(pack(spark, sf), frames.brand_news(spark, sf), frames.insider(spark, sf), fu, AS_OF), 4)


@query("k18_anomalies", f"""{BRIEF} SELECT symbol, 'volume' AS kind, {r('volume / v10', 4)} AS value FROM j WHERE volume / v10 > 2 UNION ALL SELECT symbol, 'move', {r('d1', 4)} FROM j WHERE abs(d1) > 8""")
def _(spark, sf):
    return tidy(screens.anomalies(pack(spark, sf)), 4)


@query("k19_regime_signal", f"""WITH {BARS5}, g AS (SELECT session, arg_min(open, ts) FILTER (symbol = 'view') AS o, arg_max(close, ts) FILTER (symbol = 'view') AS c, max(high) FILTER (symbol = 'view') AS h, min(low) FILTER (symbol = 'view') AS l
    FROM bars5 WHERE symbol IN ('view', 'click') GROUP BY 1), v AS (SELECT session, (c - o) / o * 100 AS chg, (h - l) / o * 100 AS rng FROM g), m AS (SELECT session, {regime_case('rng', 'chg')} AS regime, chg FROM v)
  SELECT session, symbol, regime, CASE regime WHEN 'trending_up' THEN 'bullish' WHEN 'trending_down' THEN 'bearish' ELSE 'neutral' END AS signal, {r('abs(coalesce(chg, 0))', 4)} AS confidence FROM (SELECT DISTINCT session, symbol FROM bars5) JOIN m USING (session)""")
def _(spark, sf):
    b = frames.bars5(spark, sf)
    reg = aggs.session_regime(b, *frames.anchors()).select("session", "regime", F.abs("spy_change_pct").alias("confidence"))
    return tidy(screens.regime_signal(reg, b.select("session", "symbol").distinct(), "session"), 4)


SCREEN_QUERIES = {"technical": "k04_technical", "fundamentals": "k01_fundamentals", "growth": "k02_growth", "sentiment": "k03_sentiment", "graham": "k06_graham", "ackman": "k09_ackman",
                  "wood": "k10_wood", "burry": "k11_burry", "lynch": "k12_lynch", "pabrai": "k15_pabrai", "munger": "k08_munger", "fisher": "k13_fisher",
                  "druckenmiller": "k14_druckenmiller", "damodaran": "k16_damodaran", "jhunjhunwala": "k17_jhunjhunwala"}
# the technical screen has a query of its own over other bars
FUNDAMENTAL = [n for n in SCREEN_QUERIES if n != "technical"]


@query("x03_run_screens", " UNION ALL ".join(f"SELECT '{n}' AS analyst, symbol, signal FROM ({registry.ORACLES[SCREEN_QUERIES[n]]})" for n in FUNDAMENTAL))
def _(spark, sf):
    given = {"panel": pan(spark, sf), "insider": frames.insider(spark, sf), "news": frames.brand_news(spark, sf), "bars": frames.brand_bars(spark, sf), "as_of": AS_OF, "words": WORDS}
    return screens.run_screens(FUNDAMENTAL, given)
