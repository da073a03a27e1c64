"""How often rows are shuffled, and what the ledgers give on either side of BUSY."""

import random

import pytest
from pyspark.sql import functions as F

from barwright.operators import portfolio, risk
from tests.test_portfolio import check_books, plain_books


def shuffles_of(df, column):
    """Exchanges in the plan of ``df`` that carry a column."""
    plan = df.sparkSession.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    blocks = [x.split("\n") for x in plan.split("\n\n")]
    return sum(any(x.startswith("Input") and f"{column}#" in x for x in b) for b in blocks if any(x.split(") ")[-1].startswith("Exchange") for x in b[:2]))


@pytest.fixture
def large(spark):
    """Plans as for tables that are too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def trades(spark):
    p = spark.createDataFrame([
        (1, "NVDA", "buy", 1, 10.0, 0), (1, "nvda", "BUY", 8, 10.0, 1), (1, "AVGO", "short", 20, 10.0, 2), (1, "COIN", "buy", 1, 10.0, 3), (1, "KO", "buy", 1, 10.0, 4),
        (2, "NVDA", "buy", 1, 10.0, 5), (3, "NVDA", "buy", 1, 10.0, 6), (3, "NVDA", "sell", 1, 10.0, 7), (1, "IONQ", "buy", 1, 1.0, 8), (1, "AVGO", "jump", 1, 1.0, 9),
    ], "account long, symbol string, action string, qty long, entry_price double, seq int")
    state = spark.createDataFrame([(a, 1000.0, 900.0, 0.9, 0.0, 0.0, 1, 0) for a in (1, 2)],
                                  "account long, equity double, cash double, cash_pct double, daily_pnl_pct double, weekly_pnl_pct double, open_position_count long, trade_count_today long")
    pos = spark.createDataFrame([(1, "NVDA", 1, 10.0), (1, "MSFT", 5, 270.0), (1, "MSTR", 2, 25.0)], "account long, symbol string, qty long, market_value double")
    return p, state, pos


def test_trade_rules_over_held_symbols_and_sectors(spark):
    got = {r.seq: r.rule for r in risk.validate_trades(*trades(spark), spark, "swing").collect()}
    assert got == {0: None, 1: "max_position_size", 2: "max_position_size", 3: "max_tactical_pct", 4: None, 5: None,
                   6: "no_account_state", 7: None, 8: "moonshot_blocked", 9: "unknown_action"}
    p, state, pos = trades(spark)
    more = p.where("seq = 2").withColumn("qty", F.lit(3).cast("long"))
    assert [r.rule for r in risk.validate_trades(more, state, pos, spark, "swing").collect()] == ["max_sector_pct"]


def test_proposals_are_shuffled_once(spark, large):
    """Before, by account and symbol, by account and sector, and by account (F3, F4)."""
    assert shuffles_of(risk.validate_trades(*trades(spark), spark, "day"), "entry_price") == 1


def many_fills(spark, n, symbols="AB"):
    rng = random.Random(5)
    fills = [(rng.choice(["buy", "buy", "sell", "short", "cover"]), rng.choice(symbols), rng.randint(1, 60), rng.randint(5, 90)) for _ in range(n)]
    rows = [(a, s, q, float(p), act, i, f"2024-01-{1 + i * 28 // n:02d}") for i, (act, s, q, p) in enumerate(fills) for a in ((1, 2) if i < n // 2 else (1,))]
    f = spark.createDataFrame(rows, "account long, symbol string, qty long, price double, action string, seq int, day string").withColumn("day", F.to_date("day"))
    return fills, f, spark.createDataFrame([(1, 9_000.0), (2, 50.0)], "account long, cash double")


def test_margin_ledger_on_both_sides_of_busy(spark):
    fills, f, o = many_fills(spark, 300)
    led = portfolio.margin_ledger(f, o, busy=200).orderBy("n").collect()
    check_books([r for r in led if r.account == 1], plain_books(fills, 9_000.0, 0.5))
    check_books([r for r in led if r.account == 2], plain_books(fills[:150], 50.0, 0.5))
    both = [sorted(portfolio.symbol_ledger(f, busy=n).select("account", "symbol", "day", "qty", "position", F.round("cost_basis", 6), F.round("realized", 4)).collect()) for n in (10, 10_000)]
    assert both[0] == both[1]


def test_fills_of_calm_accounts_are_shuffled_once(spark, large):
    """Without busy accounts one shuffle of the fills is left; before, each book met its blocks several times (F2)."""
    _, f, o = many_fills(spark, 40)
    seen = []
    portfolio._levels(f, ("account",), "day", 100, lambda x, by: seen.append((x, by)) or x)
    calm = portfolio.book(seen[0][0], ("buy", "short"), ("sell", "cover"), ("account", "symbol"), None)
    assert seen[0][1] is None and shuffles_of(portfolio._running(calm, {"x": "price"}, ("account",), ("seq",), None), "price") == 1


def plain_curve(rows, cash):
    """Values by date of one account's (symbol, qty, price, action, day) in order; prices of all its fills."""
    last, held, out = {}, {}, {}
    for s, q, p, act, day in rows:
        sign = 1 if act in ("buy", "cover") else -1
        cash, held[s], last[s] = cash - sign * q * p, held.get(s, 0) + sign * q, p
        out[day] = cash + sum(n * last[x] for x, n in held.items())
    return out


def test_equity_curve_on_both_sides_of_busy(spark):
    _, f, o = many_fills(spark, 240, "ABCD")
    f = f.where("account = 1")
    rows = [(r.symbol, r.qty, r.price, r.action, r.day) for r in f.orderBy("seq").collect()]
    f = f.unionByName(f.withColumn("account", F.lit(2).cast("long")).where("action <> 'cover'"))
    for busy in (220, 10_000):
        got = portfolio.equity_curve(f, portfolio.daily_prices(f.where("account = 1")), o, busy=busy).where("account = 1").orderBy("date", "seq").collect()
        want = plain_curve(rows, 9_000.0)
        assert got[0].seq == 0 and got[0].value == 9_000.0 and got[0].date == min(want)
        assert {r.date: r.value for r in got[1:]} == pytest.approx(want)


def test_days_of_calm_accounts_are_shuffled_once(spark, tmp_path):
    """One shuffle carries the cash of the fills; positions over all dates stay in their task (F5)."""
    _, f, o = many_fills(spark, 40)
    f.write.parquet(str(tmp_path / "f"))
    portfolio.daily_prices(f).write.parquet(str(tmp_path / "p"))
    f, p = (spark.read.parquet(str(tmp_path / x)) for x in "fp")
    # two for busy accounts: by account, symbol and day, then by account
    assert shuffles_of(portfolio.equity_curve(f, p, o), "_cash") + shuffles_of(portfolio.equity_curve(f, p, o), "sum(_cash)") <= 3
    assert shuffles_of(portfolio.equity_curve(f, p, o), "_pos") == 0
