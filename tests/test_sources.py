"""Readers and writers on small files in the landed shapes."""

import json

import pytest
from pyspark.sql import functions as F

from barwright.sources import readers, sinks, universe


def put(path, text):
    path.write_text(text)
    return str(path)


def test_price_envelope(spark, tmp_path):
    f = put(tmp_path / "p.json", json.dumps({"ticker": "AAPL", "prices": [
        {"ticker": "AAPL", "open": 179.55, "close": 169, "high": 180.53, "low": 177.38, "volume": 73450582, "time": "2024-03-01T05:00:00Z", "time_milliseconds": 1},
    ]}, indent=1))
    r = readers.read_bars_json(spark, f).first()
    assert (r.symbol, r.close, r.volume) == ("AAPL", 169.0, 73450582)


def test_metrics_and_insider(spark, tmp_path):
    f = put(tmp_path / "m.json", json.dumps({"financial_metrics": [{"ticker": "A", "report_period": "2024-03-01", "market_cap": 5, "interest_coverage": None}]}))
    m = readers.read_metrics_json(spark, f).first()
    assert (m.market_cap, m.interest_coverage, str(m.report_period)) == (5.0, None, "2024-03-01")
    f = put(tmp_path / "i.json", json.dumps({"insider_trades": [{"ticker": "A", "transaction_shares": -5, "is_board_director": True}]}))
    assert readers.read_insider_json(spark, f).first().transaction_shares == -5.0


def test_news_layouts(spark, tmp_path):
    rows = [{"ticker": "A", "title": "flat", "publisher": "P", "link": "L", "providerPublishTime": 1704067200},
            {"ticker": "A", "title": "", "content": {"title": "nested", "pubDate": "2024-01-05T00:00:00Z", "provider": {"displayName": "Q"}, "canonicalUrl": {"url": "U"}}},
            {"ticker": "A", "title": ""}, {"ticker": "A", "title": "late", "content": {"pubDate": "2025-01-01T00:00:00Z"}}]
    f = put(tmp_path / "n.json", "\n".join(map(json.dumps, rows)))
    got = {r.title: (r.source, r.url) for r in readers.normalize_news(readers.read_news_json(spark, f), "2024-01-01", "2024-12-31").collect()}
    assert got == {"flat": ("P", "L"), "nested": ("Q", "U")}


def test_journal_skips_bad_lines(spark, tmp_path):
    f = put(tmp_path / "j.jsonl", '{"timestamp": "2024-01-02", "ticker": "A", "order_id": "1"}\n{broken\n{"timestamp": "2024-01-03", "ticker": "B", "order_id": "2"}\n')
    assert [r.ticker for r in readers.read_journal(spark, f, limit=1).collect()] == ["B"]
    assert readers.read_journal(spark, f, ticker="a").count() == 1
    assert readers.read_journal(spark, f, since="2024-01-03").count() == 1


def test_bar_arrays(spark, tmp_path):
    f = put(tmp_path / "bars5m_SPY_2024-01-02.json", json.dumps([{"t": "2024-01-02T14:30:00Z", "o": 1, "h": 2, "l": 0.5, "c": 1.5}]))
    r = readers.read_bar_arrays(spark, f).first()
    assert (r.symbol, r.close, r.volume) == ("SPY", 1.5, 0.0)


def test_xbrl_units_and_forms(spark):
    doc = {"facts": {"us-gaap": {"EarningsPerShareBasic": {"units": {"USD/shares": [{"val": 1.5, "end": "2023-12-31", "form": "10-K"}]}},
                                 "Revenues": {"units": {"USD": [{"val": 5, "end": "2023-09-30", "form": "8-K"}, {"val": 7, "end": "2023-12-31", "form": "10-Q"}]}},
                                 "Odd": {"units": {"EUR": [{"val": 9, "end": "2023-12-31", "form": "10-K"}]}}}}}
    df = spark.createDataFrame([("A", json.dumps(doc))], "symbol string, json string")
    q = {(r.concept, r.val) for r in readers.flatten_xbrl(df, "quarterly").collect()}
    assert q == {("EarningsPerShareBasic", 1.5), ("Revenues", 7.0), ("Odd", 9.0)}
    assert readers.flatten_xbrl(df, "annual").count() == 2
    assert readers.flatten_xbrl(df, "ttm").count() == 4


def test_line_items_first_concept_with_data_wins(spark):
    rows = [("A", "SalesRevenueNet", 0, 5.0, "2023-12-31", "f"), ("A", "RevenueFromContractWithCustomerExcludingAssessedTax", 0, 7.0, "2023-12-31", "f"),
            ("A", "RevenueFromContractWithCustomerExcludingAssessedTax", 1, 8.0, "2023-12-31", "f"), ("A", "NetCashProvidedByUsedInOperatingActivities", 0, 10.0, "2023-12-31", "f"),
            ("A", "PaymentsToAcquirePropertyPlantAndEquipment", 0, 4.0, "2023-12-31", "f")]
    obs = spark.createDataFrame(rows, "symbol string, concept string, pos int, val double, end string, filed string")
    r = readers.extract_line_items(obs, ["revenue", "free_cash_flow"], "2024-01-01").first()
    assert (r.revenue, r.free_cash_flow) == (7.0, 6.0)
    assert readers.extract_line_items(obs, ["revenue", "free_cash_flow"], "2024-01-01", compat=True).first().free_cash_flow == 10.0
    assert readers.extract_line_items(obs, ["revenue"], "2023-01-01").count() == 0


def test_form4_sign(spark, tmp_path):
    xml = """<ownershipDocument><issuer><issuerTradingSymbol>A</issuerTradingSymbol></issuer><reportingOwner><reportingOwnerId><rptOwnerName>N</rptOwnerName></reportingOwnerId>
      <reportingOwnerRelationship><isDirector>1</isDirector></reportingOwnerRelationship></reportingOwner><nonDerivativeTable><nonDerivativeTransaction><securityTitle><value>C</value></securityTitle>
      <transactionDate><value>2024-01-02</value></transactionDate><transactionAmounts><transactionShares><value>10</value></transactionShares><transactionPricePerShare><value>2.5</value></transactionPricePerShare>
      <transactionAcquiredDisposedCode><value>D</value></transactionAcquiredDisposedCode></transactionAmounts></nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>"""
    r = readers.read_form4_xml(spark, put(tmp_path / "f.xml", xml)).first()
    assert (r.transaction_shares, r.transaction_value, r.is_board_director) == (-10.0, 25.0, True)


def test_snapshots_are_idempotent(spark, tmp_path):
    p = str(tmp_path / "snaps")

    def snaps(*rows):
        return spark.createDataFrame(rows, "account string, date string, equity double").withColumn("date", F.to_date("date"))

    def held():
        return sorted((r.account, str(r.date)[-2:], r.equity) for r in readers.read_snapshots(spark, p).collect())

    sinks.write_snapshots(snaps(("a", "2024-01-02", 1.0)), p)
    sinks.write_snapshots(snaps(("b", "2024-01-02", 5.0), ("a", "2024-01-02", 9.0), ("a", "2024-01-03", 2.0)), p)
    assert held() == [("a", "02", 1.0), ("a", "03", 2.0), ("b", "02", 5.0)]
    sinks.write_snapshots(snaps(("b", "2024-01-02", 6.0)), p, force=True)
    assert held() == [("a", "02", 1.0), ("a", "03", 2.0), ("b", "02", 6.0)]
    assert readers.read_snapshots(spark, p, "2024-01-03").count() == 1


def test_journal_append_and_alert_log(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-02T10:00:00", "A", "executed"), ("2024-01-02T11:00:00", "B", "skipped")], "timestamp string, ticker string, status string")
    sinks.append_journal(df, str(tmp_path / "j"))
    sinks.append_journal(df, str(tmp_path / "j"))
    assert readers.read_journal(spark, str(tmp_path / "j")).count() == 2
    sinks.append_json(df.select("ticker"), str(tmp_path / "a"))
    assert "timestamp" in spark.read.json(str(tmp_path / "a")).columns


def test_runs_and_experiments(spark, tmp_path):
    f = put(tmp_path / "e.jsonl", json.dumps({"experiment_id": "x", "metrics": {"sharpe_ratio": 1.5}, "kept": True, "fitness_score": 2.0}) + "\nnot json\n")
    assert readers.read_experiments(spark, f).first().metrics["sharpe_ratio"] == 1.5
    f = put(tmp_path / "r.jsonl", json.dumps({"run_id": "r", "keep_count": 6, "total_experiments": 50}))
    assert readers.read_runs(spark, f).first().keep_count == 6


def test_merge_keeps_duplicates_of_the_new_batch(spark):
    old = spark.createDataFrame([("1", 1)], "k string, v int")
    new = spark.createDataFrame([("1", 9), ("2", 2), ("2", 3)], "k string, v int")
    assert sorted(map(tuple, sinks.merge_keep_existing(old, new, "k").collect())) == [("1", 1), ("2", 2), ("2", 3)]


def test_universe(spark):
    u = universe.universe_df(spark, "swing")
    assert u.count() == 28 and u.filter("symbol = 'COIN'").first().max_per_stock_pct == 0.05
    lim = {r.mode: r for r in universe.risk_limits_df(spark).collect()}
    assert lim["day"].flatten_minute == 945 and not lim["swing"].allow_leveraged_etfs


@pytest.mark.parametrize("title,score", [("A fraud lawsuit", 3.0), ("All is well", 8.0)])
def test_headline_words(spark, title, score):
    from barwright.operators.aggs import headline_score
    assert headline_score(spark.createDataFrame([("A", title)], "symbol string, title string")).first().score == score


def test_filings_after_the_date_change_nothing(spark, sf):
    from barwright.catalog.fundamentals import AS_OF, pan
    from barwright.plans import screens
    from barwright.sources import frames
    late = spark.createDataFrame([("Brand#11", "2001-10-05", 1e9, 1e9)], "symbol string, filing_date string, transaction_shares double, transaction_value double")
    late = late.withColumn("filing_date", F.to_date("filing_date"))
    ins, news = frames.insider(spark, sf), frames.brand_news(spark, sf)
    rows = lambda i: sorted(map(str, screens.screen_munger(pan(spark, sf), i, AS_OF).collect()))
    assert rows(ins) == rows(ins.unionByName(late))
    burry = lambda n: sorted(map(str, screens.screen_burry(pan(spark, sf), ins, n, AS_OF).collect()))
    bad = news.limit(1).withColumns({"date": F.lit("2001-10-05").cast("date"), "sentiment": F.lit("negative")})
    assert burry(news) == burry(news.unionByName(bad.unionByName(bad).unionByName(bad).unionByName(bad).unionByName(bad)))
