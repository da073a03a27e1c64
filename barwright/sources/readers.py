"""Readers of landed files, as explicit-schema JSON/XML scans plus explode.

Every reader has a ``parse_*`` twin that takes the same text as a column, so files, message
payloads and columns share one path. Schemas are never inferred.
"""

from pyspark.sql import Window as W, functions as F

BAR = "ticker string, open double, close double, high double, low double, volume long, time string"
METRIC_KEYS = "ticker string, report_period string, fiscal_period string, period string, currency string"
# The ratio fields of a metrics record.
METRIC_FIELDS = [
    "market_cap", "enterprise_value", "price_to_earnings_ratio", "price_to_book_ratio", "price_to_sales_ratio",
    "enterprise_value_to_ebitda_ratio", "enterprise_value_to_revenue_ratio", "free_cash_flow_yield", "peg_ratio",
    "gross_margin", "operating_margin", "net_margin", "return_on_equity", "return_on_assets", "return_on_invested_capital",
    "asset_turnover", "inventory_turnover", "receivables_turnover", "days_sales_outstanding", "operating_cycle",
    "working_capital_turnover", "current_ratio", "quick_ratio", "cash_ratio", "operating_cash_flow_ratio", "debt_to_equity",
    "debt_to_assets", "interest_coverage", "revenue_growth", "earnings_growth", "book_value_growth",
    "earnings_per_share_growth", "free_cash_flow_growth", "operating_income_growth", "ebitda_growth", "payout_ratio",
    "earnings_per_share", "book_value_per_share", "free_cash_flow_per_share",
]
METRIC = METRIC_KEYS + ", " + ", ".join(f"{f} double" for f in METRIC_FIELDS)
INSIDER = ("ticker string, issuer string, name string, title string, is_board_director boolean, transaction_date string, "
           "transaction_shares double, transaction_price_per_share double, transaction_value double, "
           "shares_owned_before_transaction double, shares_owned_after_transaction double, security_title string, filing_date string")
NEWS = ("ticker string, title string, publisher string, link string, providerPublishTime long, content struct<title:string, pubDate:string, "
        "provider:struct<displayName:string>, canonicalUrl:struct<url:string>>")
XBRL = "facts map<string, map<string, struct<units:map<string, array<struct<val:double, end:string, filed:string, form:string, fp:string>>>>>>"
JOURNAL = "timestamp string, mode string, ticker string, action string, qty double, status string, reasoning string, order_id string, error string, pnl double"
OPTIONS = {"mode": "PERMISSIVE"}


def _records(df, name):
    return df.select(F.explode(name).alias("r")).select("r.*")


def _as_bars(df):
    return df.select(F.col("ticker").alias("symbol"), F.try_to_timestamp("time").alias("ts"), "open", "high", "low", "close", "volume")


def read_bars_json(spark, path):
    return _as_bars(_records(spark.read.schema(f"ticker string, prices array<struct<{_fields(BAR)}>>").json(path, multiLine=True), "prices"))


def _fields(ddl):
    return ", ".join(f"{n}:{t}" for n, t in (c.split(" ", 1) for c in ddl.split(", ")))


def parse_bars(df, text="json"):
    return _as_bars(_records(df.select(F.from_json(text, f"ticker string, prices array<struct<{_fields(BAR)}>>").alias("d")).select("d.*"), "prices"))


def _as_metrics(df):
    return df.withColumn("report_period", F.to_date("report_period"))


def read_metrics_json(spark, path):
    return _as_metrics(_records(spark.read.schema(f"financial_metrics array<struct<{_fields(METRIC)}>>").json(path, multiLine=True), "financial_metrics"))


def parse_metrics(df, text="json"):
    return _as_metrics(_records(df.select(F.from_json(text, f"financial_metrics array<struct<{_fields(METRIC)}>>").alias("d")).select("d.*"), "financial_metrics"))


def read_insider_json(spark, path):
    return _records(spark.read.schema(f"insider_trades array<struct<{_fields(INSIDER)}>>").json(path, multiLine=True), "insider_trades")


def parse_insider(df, text="json"):
    return _records(df.select(F.from_json(text, f"insider_trades array<struct<{_fields(INSIDER)}>>").alias("d")).select("d.*"), "insider_trades")


def read_news_json(spark, path):
    return spark.read.schema(NEWS).json(path)


def normalize_news(df, start=None, end=None):
    """Flat and nested news records to one shape; untitled ones go, dates are inclusive, undated stay."""
    def pick(flat, nested):
        return F.coalesce(F.nullif(flat, F.lit("")), nested)

    when = F.coalesce(F.date_format(F.timestamp_seconds("providerPublishTime"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.col("content.pubDate"))
    n = df.select(
        F.col("ticker").alias("symbol"), pick("title", F.col("content.title")).alias("title"), pick("publisher", F.col("content.provider.displayName")).alias("source"),
        pick("link", F.col("content.canonicalUrl.url")).alias("url"), when.alias("date"))
    n = n.filter(F.coalesce(F.col("title"), F.lit("")) != "")
    day = F.substring_index("date", "T", 1)
    undated = F.coalesce(F.col("date"), F.lit("")) == ""
    if end is not None:
        n = n.filter(undated | (day <= end))
    if start is not None:
        n = n.filter(undated | (day >= start))
    return n


def flatten_xbrl(df, period="quarterly", unit="USD", text="json", key="symbol"):
    """Company facts to observations: one unit per concept (the asked one, USD/shares, pure, else any);
    10-Q and 10-K forms for quarterly, 10-K for annual, no form filter for ttm."""
    d = df.select(key, F.from_json(text, XBRL).alias("d"))
    ns = d.select(key, F.explode("d.facts").alias("namespace", "concepts"))
    c = ns.select(key, "namespace", F.explode("concepts").alias("concept", "body")).select(key, "namespace", "concept", F.col("body.units").alias("u"))

    def known(name):
        obs = F.try_element_at("u", F.lit(name))
        return F.when(F.size(obs) > 0, obs)

    first = F.get(F.map_values("u"), F.lit(0))
    obs = c.select(key, "namespace", "concept", F.posexplode(F.coalesce(known(unit), known("USD/shares"), known("pure"), first)).alias("pos", "o")).select(key, "namespace", "concept", "pos", "o.*")
    forms = {"quarterly": ["10-Q", "10-K"], "annual": ["10-K"]}.get(period)
    return obs.filter(F.col("form").isin(forms)) if forms else obs


# Line item -> XBRL concepts in order of preference.
CONCEPTS = {
    "revenue": ["Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "SalesRevenueNet"],
    "total_revenue": ["Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "SalesRevenueNet"],
    "cost_of_revenue": ["CostOfRevenue", "CostOfGoodsAndServicesSold", "CostOfGoodsSold"],
    "gross_profit": ["GrossProfit"],
    "operating_income": ["OperatingIncomeLoss"],
    "operating_expense": ["OperatingExpenses"],
    "net_income": ["NetIncomeLoss"],
    "ebitda": ["EarningsBeforeInterestTaxesDepreciationAndAmortization"],
    "interest_expense": ["InterestExpense"],
    "income_tax_expense": ["IncomeTaxExpenseBenefit"],
    "depreciation_and_amortization": ["DepreciationDepletionAndAmortization", "DepreciationAndAmortization"],
    "research_and_development": ["ResearchAndDevelopmentExpense"],
    "selling_general_and_administrative": ["SellingGeneralAndAdministrativeExpense"],
    "total_assets": ["Assets"],
    "total_liabilities": ["Liabilities"],
    "total_equity": ["StockholdersEquity"],
    "current_assets": ["AssetsCurrent"],
    "current_liabilities": ["LiabilitiesCurrent"],
    "cash_and_equivalents": ["CashAndCashEquivalentsAtCarryingValue"],
    "cash_and_short_term_investments": ["CashCashEquivalentsAndShortTermInvestments"],
    "inventory": ["InventoryNet"],
    "accounts_receivable": ["AccountsReceivableNetCurrent"],
    "accounts_payable": ["AccountsPayableCurrent"],
    "long_term_debt": ["LongTermDebt", "LongTermDebtNoncurrent"],
    "short_term_debt": ["ShortTermBorrowings"],
    "total_debt": ["LongTermDebt", "DebtCurrent"],
    "goodwill": ["Goodwill"],
    "intangible_assets": ["IntangibleAssetsNetExcludingGoodwill"],
    "shareholders_equity": ["StockholdersEquity"],
    "retained_earnings": ["RetainedEarningsAccumulatedDeficit"],
    "book_value_per_share": ["BookValuePerShareDiluted"],
    "outstanding_shares": ["CommonStockSharesOutstanding", "EntityCommonStockSharesOutstanding"],
    "operating_cash_flow": ["NetCashProvidedByUsedInOperatingActivities"],
    "capital_expenditure": ["PaymentsToAcquirePropertyPlantAndEquipment"],
    "dividends_paid": ["PaymentsOfDividends", "PaymentsOfDividendsCommonStock"],
    "share_repurchase": ["PaymentsForRepurchaseOfCommonStock"],
    "issuance_of_debt": ["ProceedsFromIssuanceOfLongTermDebt"],
    "repayment_of_debt": ["RepaymentsOfLongTermDebt"],
    "net_income_from_cash_flow": ["NetIncomeLoss"],
    "depreciation_from_cash_flow": ["DepreciationDepletionAndAmortization"],
    "ebit": ["OperatingIncomeLoss"],
    "income_before_tax": ["IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest"],
    "weighted_average_shares": ["WeightedAverageNumberOfShareOutstandingBasicAndDiluted", "CommonStockSharesOutstanding"],
    "net_cash_from_operations": ["NetCashProvidedByUsedInOperatingActivities"],
    "net_cash_from_investing": ["NetCashProvidedByUsedInInvestingActivities"],
    "net_cash_from_financing": ["NetCashProvidedByUsedInFinancingActivities"],
}


def extract_line_items(obs, items, as_of, limit=10, concepts=CONCEPTS, compat=False):
    """Wide line items of the newest ``limit`` periods up to ``as_of``.

    Of an item's concepts the first with any data wins; of a period's observations the first.
    Free cash flow is operating cash flow less capital spending (``compat``: not subtracted).
    """
    unknown = [i for i in items if i != "free_cash_flow" and i not in concepts]
    if unknown:
        raise ValueError(f"no concepts for line items {unknown}")
    need = [i for i in items if i != "free_cash_flow"]
    if "free_cash_flow" in items:
        need += [i for i in ("operating_cash_flow", "capital_expenditure") if i not in need]
    pairs = [F.struct(F.lit(i).alias("item"), F.lit(c).alias("c"), F.lit(k).alias("prio")) for i in need for k, c in enumerate(concepts[i])]
    # the map from items to concepts is a literal array: matching is a filter, not a join
    o = obs.withColumn("m", F.explode(F.filter(F.array(*pairs), lambda p: p["c"] == F.col("concept")))).select("symbol", "m.item", "m.prio", "end", "filed", "pos", "val")
    best = o.groupBy("symbol", "item").agg(F.min("prio").alias("prio"))
    o = o.join(best, ["symbol", "item", "prio"]).filter((F.col("end") != "") & (F.col("end") <= as_of))
    v = o.groupBy("symbol", "end", "item").agg(F.min_by("val", F.struct("filed", "pos")).alias("val"))
    wide = v.groupBy("symbol", F.to_date("end").alias("report_period")).pivot("item", need).agg(F.first("val"))
    newest = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("report_period")))
    wide = wide.withColumn("_r", newest).filter(F.col("_r") <= limit).drop("_r")
    if "free_cash_flow" in items:
        spend = F.lit(0.0) if compat else F.coalesce("capital_expenditure", F.lit(0.0))
        wide = wide.withColumn("free_cash_flow", F.col("operating_cash_flow") - spend)
    return wide.select("symbol", "report_period", *items)


def historical_ratios(line_items):
    """Ratios the statements alone allow; the operating margin is net income over revenue."""
    def d(a, b):
        return F.try_divide(F.col(a), F.col(b))

    return line_items.select(
        "symbol", "report_period", d("net_income", "revenue").alias("operating_margin"), d("net_income", "revenue").alias("net_margin"),
        d("net_income", "shareholders_equity").alias("return_on_equity"), d("net_income", "total_assets").alias("return_on_assets"),
        d("revenue", "total_assets").alias("asset_turnover"), d("total_debt", "shareholders_equity").alias("debt_to_equity"), d("total_debt", "total_assets").alias("debt_to_assets"))


def statement_ratios(df, names):
    """Ratio block of each period against the one before.

    ``names`` maps a line to the alternative columns it may come under; the first known one counts.
    """
    def v(line):
        return F.coalesce(*[F.col(c) for c in names[line]])

    d = df.select("symbol", "report_period", *[v(x).alias(x) for x in names])
    w = W.partitionBy("symbol").orderBy("report_period")

    def nz(c):
        return F.nullif(F.col(c), F.lit(0.0))

    def growth(c):
        p = F.lag(c).over(w)
        return F.try_divide(F.col(c) - p, F.abs(p)).alias(f"{c}_growth")

    inv, rec = F.try_divide("cogs", "inventory"), F.try_divide("revenue", "receivables")
    dso, dio = F.try_divide(F.lit(365.0), rec), F.try_divide(F.lit(365.0), inv)
    wc = nz("current_assets") - nz("current_liabilities")
    return d.select(
        "symbol", "report_period", F.try_divide("ebit", nz("total_assets") - nz("current_liabilities")).alias("return_on_invested_capital"),
        F.try_divide("revenue", "total_assets").alias("asset_turnover"), inv.alias("inventory_turnover"), rec.alias("receivables_turnover"),
        dso.alias("days_sales_outstanding"), (dio + dso).alias("operating_cycle"), F.try_divide(F.col("revenue"), wc).alias("working_capital_turnover"),
        F.try_divide("cash", "current_liabilities").alias("cash_ratio"), F.try_divide("operating_cash_flow", "current_liabilities").alias("operating_cash_flow_ratio"),
        F.try_divide("total_debt", "total_assets").alias("debt_to_assets"), F.try_divide(F.col("ebit"), F.abs(nz("interest_expense"))).alias("interest_coverage"),
        *[growth(c) for c in ("revenue", "net_income", "free_cash_flow", "operating_income", "ebitda")])


def explode_filings(df, start=None, end=None, limit=None, key="symbol"):
    """Parallel filing arrays to rows of forms 4 and 4/A, in index order, first ``limit`` per key."""
    f = df.select(key, F.posexplode(F.arrays_zip("form", "filingDate", "accessionNumber")).alias("pos", "f")).select(key, "pos", "f.*")
    f = f.filter(F.col("form").isin("4", "4/A"))
    if end is not None:
        f = f.filter(F.col("filingDate") <= end)
    if start is not None:
        f = f.filter(F.col("filingDate") >= start)
    if limit is not None:
        f = f.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy("pos"))).filter(F.col("_r") <= limit).drop("_r")
    return f


VALUE = "struct<value:{t}>"
FORM4 = ("issuer struct<issuerTradingSymbol:string>, reportingOwner array<struct<reportingOwnerId:struct<rptOwnerName:string>, "
         "reportingOwnerRelationship:struct<isDirector:string, officerTitle:string>>>, "
         "nonDerivativeTable struct<nonDerivativeTransaction:array<struct<securityTitle:struct<value:string>, transactionDate:struct<value:string>, "
         "transactionAmounts:struct<transactionShares:struct<value:double>, transactionPricePerShare:struct<value:double>, transactionAcquiredDisposedCode:struct<value:string>>, "
         "postTransactionAmounts:struct<sharesOwnedFollowingTransaction:struct<value:double>>>>>")


def _as_form4(d):
    # a joint filing names several owners of the same trades: one row per owner and trade
    d = d.select("issuer", "nonDerivativeTable", F.explode_outer("reportingOwner").alias("owner"))
    t = d.select(F.col("issuer.issuerTradingSymbol").alias("symbol"), F.col("owner.reportingOwnerId.rptOwnerName").alias("name"),
                 F.col("owner.reportingOwnerRelationship").alias("rel"), F.explode("nonDerivativeTable.nonDerivativeTransaction").alias("t"))
    shares, price = F.col("t.transactionAmounts.transactionShares.value"), F.col("t.transactionAmounts.transactionPricePerShare.value")
    sold = F.col("t.transactionAmounts.transactionAcquiredDisposedCode.value") == "D"
    return t.select(
        "symbol", "name", F.col("rel.officerTitle").alias("title"), F.col("rel.isDirector").isin("1", "true").alias("is_board_director"),
        F.to_date("t.transactionDate.value").alias("transaction_date"), F.when(sold, -shares).otherwise(shares).alias("transaction_shares"),
        price.alias("transaction_price_per_share"), F.abs(shares * price).alias("transaction_value"),
        F.col("t.postTransactionAmounts.sharesOwnedFollowingTransaction.value").alias("shares_owned_after_transaction"), F.col("t.securityTitle.value").alias("security_title"))


def read_form4_xml(spark, path):
    return _as_form4(spark.read.format("xml").option("rowTag", "ownershipDocument").schema(FORM4).load(path))


def parse_form4(df, text="xml"):
    return _as_form4(df.select(F.from_xml(text, FORM4).alias("d")).select("d.*"))


BAR_ARRAY = "array<struct<t:string, o:double, h:double, l:double, c:double, v:double>>"


def read_bar_arrays(spark, path):
    """Files that each hold one array of bars; the symbol is the second part of the file name."""
    raw = spark.read.text(path, wholetext=True).select("value", F.split(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), "_")[1].alias("symbol"))
    return parse_bar_arrays(raw, "value")


def parse_bar_arrays(df, text="json"):
    b = df.select("symbol", F.explode(F.from_json(text, BAR_ARRAY)).alias("b"))
    return b.select("symbol", F.try_to_timestamp("b.t").alias("ts"), F.col("b.o").alias("open"), F.col("b.h").alias("high"), F.col("b.l").alias("low"),
                    F.col("b.c").alias("close"), F.coalesce("b.v", F.lit(0.0)).alias("volume"))


def _as_journal(df, ticker, since, limit):
    if ticker:
        df = df.filter(F.col("ticker") == ticker.upper())
    if since:
        df = df.filter(F.col("timestamp") >= since)
    return df.orderBy(F.desc("timestamp"), F.desc("order_id")).limit(limit) if limit else df


def read_journal(spark, path, ticker=None, since=None, limit=None):
    """JSON lines; unreadable lines are skipped. ``limit`` keeps the newest entries."""
    return _as_journal(spark.read.schema(JOURNAL).option("mode", "DROPMALFORMED").json(path), ticker, since, limit)


def parse_journal(df, text="line", ticker=None, since=None, limit=None):
    bad = "_corrupt"
    j = df.select(F.from_json(text, JOURNAL + f", {bad} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}).alias("d")).select("d.*")
    return _as_journal(j.filter(F.col(bad).isNull()).drop(bad), ticker, since, limit)


def read_experiments(spark, path):
    return spark.read.schema("experiment_id string, timestamp string, iteration int, mode string, hypothesis string, diff string, fitness_score double, "
                             "metrics map<string, double>, kept boolean, error string").option("mode", "DROPMALFORMED").json(path)


def read_runs(spark, path):
    return spark.read.schema("run_id string, timestamp_start string, timestamp_end string, mode string, iterations_requested int, iterations_completed int, stop_reason string, "
                             "baseline_fitness double, best_fitness double, improvement double, keep_count int, total_experiments int, error_count int, timeout_count int, "
                             "top_hypothesis string").option("mode", "DROPMALFORMED").json(path)


def read_snapshots(spark, path, since=None):
    """Daily snapshots in folders by month; the cut-off prunes folders."""
    s = spark.read.parquet(path)
    if since is not None:
        day = F.lit(since).cast("date")
        s = s.filter((F.col("month") >= F.trunc(day, "month")) & (F.col("date") >= day))
    return s.drop("month")


def coerce_bars(df):
    """Text bars to typed ones: unreadable times and numbers become null."""
    return df.select("symbol", F.try_to_timestamp("time").alias("ts"), *[F.expr(f"try_cast({c} AS double)").alias(c) for c in ("open", "high", "low", "close", "volume")])


def between_dates(df, a, b, on="ts"):
    """Inclusive date range, the whole of the last day for timestamps; on parquet it reaches the scan."""
    return df.filter((F.col(on) >= F.lit(a).cast("date")) & (F.col(on) < F.date_add(F.lit(b).cast("date"), 1)))


def company_facts(info, registry):
    """Company dimension: the quote source leads, the registry supplies codes and a fallback name."""
    j = info.join(registry.select("symbol", F.col("name").alias("_reg"), "sic_code"), "symbol", "full")
    name = F.coalesce(*[F.nullif(c, F.lit("")) for c in ("long_name", "short_name", "_reg")], F.col("symbol"))
    return j.select("symbol", name.alias("name"), "sector", "industry", "exchange", "sic_code")


def parse_decisions(df, text, schema):
    """Decision JSON in a text column; what does not parse is null."""
    return df.withColumn("decision", F.from_json(text, schema))
