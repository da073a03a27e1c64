"""Ledger, valuation and decision rules, as numbers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from barwright.operators import aggs, portfolio
from barwright.sources import frames


def run(spark, cash, fills):
    rows = [(1, sym, qty, float(px), act, i, f"2024-01-{2 + i // 7:02d}") for i, (act, sym, qty, px) in enumerate(fills)]
    f = spark.createDataFrame(rows, "account long, symbol string, qty long, price double, action string, seq int, day string").withColumn("day", F.to_date("day"))
    o = spark.createDataFrame([(1, float(cash))], "account long, cash double")
    return portfolio.ledger(f, o).orderBy("n").collect(), portfolio.symbol_ledger(f)


def test_buy_and_round_trip(spark):
    r = run(spark, 100_000, [("buy", "A", 100, 50)])[0][-1]
    assert (r.position, r.cash) == (100, 95_000.0)
    led, sym = run(spark, 100_000, [("buy", "A", 100, 50), ("sell", "A", 100, 60)])
    assert (led[-1].position, led[-1].cash) == (0, 101_000.0)
    last = sym.collect()[-1]
    assert (last.position, last.cost_basis) == (0, 0.0) and last.realized == pytest.approx(1_000.0)


def test_short_and_cover(spark):
    a, b = run(spark, 10_000, [("short", "A", 100, 50), ("cover", "A", 40, 40)])[0]
    assert (a.position, a.cash, b.position, b.cash) == (-100, 15_000.0, -60, 13_400.0)


@pytest.mark.parametrize("action,qty", [("hold", 5), ("buy", 0), ("sell", -5)])
def test_no_op(spark, action, qty):
    led = run(spark, 1_000, [(action, "A", qty, 10), ("buy", "A", 1, 10)])[0]
    assert [(r.n, r.cash) for r in led] == [(1, 990.0)]


def test_random_sequences_match_brute_force(spark):
    rng = random.Random(7)
    fills = [(rng.choice(["buy", "buy", "sell", "short", "cover"]), rng.choice("ABC"), rng.randint(1, 60), rng.randint(5, 90)) for _ in range(150)]
    led, sym = run(spark, 5_000, fills)
    cash, pos = 5_000.0, {}
    for r, (act, s, q, px) in zip(led, fills, strict=True):
        sign = 1 if act in ("buy", "cover") else -1
        cash -= sign * q * px
        pos[s] = pos.get(s, 0) + sign * q
        assert (r.cash, r.position) == (pytest.approx(cash), pos[s])
    state, want = {}, []
    for i, (act, s, q, px) in enumerate(fills):
        if act not in ("buy", "sell"):
            continue
        held, basis, gain = state.get(s, (0, 0.0, 0.0))
        if act == "buy":
            held, basis = held + q, (basis * held + q * px) / (held + q)
        else:
            k = min(q, held)
            held, gain = held - k, gain + k * (px - basis)
            basis = basis if held else 0.0
        state[s] = (held, basis, gain)
        want.append((s, act, q, held, round(basis, 6), round(gain, 4)))
    got = [(r.symbol, r.action, r.qty, r.position, round(r.cost_basis, 6), round(r.realized, 4)) for r in sym.collect()]
    assert sorted(got) == sorted(want)


def test_cost_over_many_partial_sells(spark):
    """Half of the position goes in each of the sells, over a few days."""
    fills = [("buy", "A", 1 << 40, 3)]
    for _ in range(20):
        fills += [("sell", "A", 1 << 39, 5), ("buy", "A", 1 << 39, 7)]
    basis = 3.0
    for _ in range(20):
        basis = (basis + 7) / 2
    assert run(spark, 0, fills)[1].orderBy("day").collect()[-1].cost_basis == pytest.approx(basis)


def plain_books(fills, cash, requirement):
    """Fill by fill: longs and shorts apart, margin taken by shorts and released by covers."""
    held, margin, out = {}, 0.0, []
    for act, s, q, px in fills:
        if act == "hold" or q <= 0:
            continue
        book = "long" if act in ("buy", "sell") else "short"
        n, basis, gain = held.get((s, book), (0, 0.0, 0.0))
        if act in ("buy", "short"):
            k = q
            n, basis = n + q, (basis * n + q * px) / (n + q)
            cash += -q * px if act == "buy" else q * px * (1 - requirement)
            margin += q * px * requirement if act == "short" else 0.0
        else:
            k = min(q, n)
            gain += k * (px - basis) * (1 if act == "sell" else -1)
            freed = k * basis * requirement if act == "cover" else 0.0
            cash += k * px if act == "sell" else freed - k * px
            margin -= freed
            n -= k
            basis = basis if n else 0.0
        held[(s, book)] = (n, basis, gain)
        out.append((s, book, act, q, k, n, basis, gain, cash, margin))
    return out


def check_books(led, want):
    assert len(led) == len(want)
    for r, (s, book, act, q, k, n, basis, gain, cash, margin) in zip(led, want):
        assert (r.symbol, r.book, r.action, r.qty, r.executed, r.position) == (s, book, act, q, k, n)
        assert (r.cost_basis, r.realized, r.cash, r.margin_used) == (pytest.approx(basis), pytest.approx(gain, abs=1e-6), pytest.approx(cash, abs=1e-5), pytest.approx(margin, abs=1e-6))


def books(spark, cash, fills, requirement=0.5):
    rows = [(1, sym, qty, float(px), act, i, f"2024-01-{2 + i // 7 % 28:02d}") for i, (act, sym, qty, px) in enumerate(fills)]
    f = spark.createDataFrame(rows, "account long, symbol string, qty long, price double, action string, seq int, day string").withColumn("day", F.to_date("day"))
    o = spark.createDataFrame([(1, float(cash))], "account long, cash double")
    return portfolio.margin_ledger(f, o, requirement).orderBy("n").collect()


def test_margin_ledger_cases(spark):
    a, b = books(spark, 100_000, [("short", "A", 100, 50), ("cover", "A", 40, 40)])
    assert (a.margin_used, a.cash, a.cost_basis) == (2_500.0, 102_500.0, 50.0)
    # a gain of 10 a share, 40 % of the margin released, the price of the cover paid
    assert (b.realized, b.margin_used, b.position, b.cash) == (400.0, 1_500.0, 60, 102_500.0 + 1_000.0 - 1_600.0)
    a = books(spark, 100_000, [("short", "A", 100, 30)])[0]
    assert (a.margin_used, a.cash) == (1_500.0, 101_500.0)
    r = books(spark, 1_000, [("buy", "A", 10, 20), ("sell", "A", 25, 30), ("cover", "A", 5, 1), ("short", "A", 0, 1), ("hold", "A", 3, 1)])
    assert [(x.executed, x.position) for x in r] == [(10, 10), (10, 0), (0, 0)] and r[-1].cash == 1_100.0


def test_margin_ledger_matches_brute_force(spark):
    rng = random.Random(3)
    fills = [(rng.choice(["buy", "sell", "short", "cover", "cover"]), rng.choice("AB"), rng.randint(1, 60), rng.randint(5, 90)) for _ in range(190)]
    check_books(books(spark, 9_000, fills), plain_books(fills, 9_000.0, 0.5))


def test_one_account_and_symbol_spreads_over_blocks(spark):
    """A symbol with all the fills: cut by the hour, 20,000 fills equal the fold, and no task of the windows over fills holds them all."""
    rng = random.Random(6)
    fills = [(rng.choice(["buy", "buy", "sell", "short", "cover"]), "A", rng.randint(1, 60), rng.randint(5, 90)) for _ in range(20_000)]
    rows = [(1, s, q, float(p), a, i, i // 500) for i, (a, s, q, p) in enumerate(fills)]
    f = spark.createDataFrame(rows, "account long, symbol string, qty long, price double, action string, seq int, hour int").withColumn("day", F.lit("2024-01-02").cast("date"))
    o = spark.createDataFrame([(1, 0.0)], "account long, cash double")
    led = portfolio.margin_ledger(f, o, block="hour")
    check_books(led.orderBy("n").collect(), plain_books(fills, 0.0, 0.5))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sizes = [r["count"] for r in portfolio.book(f, "buy", "sell", block="hour").groupBy(F.spark_partition_id()).count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 4 and max(sizes) < sum(sizes) / 2


def test_ledger_is_independent_of_partitioning(spark, sf):
    f, o = frames.fills(spark, sf), frames.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("account"), F.lit(1e6).alias("cash"))
    a = portfolio.ledger(f, o).groupBy("account").agg(F.round(F.max_by("cash", "n"), 4).alias("c")).collect()
    b = portfolio.ledger(f.repartition(13, "price"), o).groupBy("account").agg(F.round(F.max_by("cash", "n"), 4).alias("c")).collect()
    assert sorted(a) == sorted(b)


def test_exposures(spark):
    v = spark.createDataFrame([(1, "A", 10, 0, 100.0), (1, "B", 0, 5, 200.0), (2, "A", 10, 0, 100.0)], "account long, symbol string, long long, short long, price double")
    v = v.withColumn("long_value", F.col("long") * F.col("price")).withColumn("short_value", F.col("short") * F.col("price"))
    a, b = portfolio.exposures(v).orderBy("account").collect()
    assert tuple(a)[1:] == (1_000.0, 1_000.0, 2_000.0, 0.0, 1.0)
    assert math.isinf(b.long_short_ratio)


def test_missing_price_raises_when_strict(spark):
    p = spark.createDataFrame([(1, "A", 10, 0)], "account long, symbol string, long long, short long")
    px = spark.createDataFrame([("B", 1.0)], "symbol string, price double")
    with pytest.raises(Exception, match="no price for A"):
        portfolio.value_positions(p, px).collect()
    assert portfolio.value_positions(p, px, strict=False).count() == 0


def test_summary(spark):
    v = spark.createDataFrame([(1, 1_000.0, 0.0)], "account long, long_value double, short_value double")
    a = spark.createDataFrame([(1, 99_000.0)], "account long, cash double")
    s = portfolio.portfolio_summary(portfolio.portfolio_value(v, a), 100_000.0).first()
    assert (s.cash_balance, s.total_position_value, s.return_pct) == (99_000.0, 1_000.0, 0.0)


def curve(spark, values):
    return spark.createDataFrame([(1, v, i) for i, v in enumerate(values)], "account long, value double, i int").withColumn(
        "date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("i")))


def test_metrics(spark):
    r = aggs.perf_metrics(curve(spark, [100.0])).first()
    assert r.sharpe_ratio is None and r.sortino_ratio is None
    d = aggs.max_drawdown(curve(spark, [100.0, 110.0, 99.0])).first()
    assert d.max_drawdown == pytest.approx(-10.0) and str(d.max_drawdown_date) == "2024-01-03"
    assert aggs.perf_metrics(curve(spark, [100.0] * 5)).first().sharpe_ratio == 0.0


def test_normalize(spark):
    d = spark.createDataFrame([("A", "buy", "10"), ("B", "jump", "x")], "symbol string, action string, quantity string")
    u = spark.createDataFrame([("A",), ("B",), ("C",)], "symbol string")
    got = {r.symbol: (r.action, r.quantity) for r in portfolio.normalize_decisions(d, u).collect()}
    assert got == {"A": ("buy", 10.0), "B": ("hold", 0.0), "C": ("hold", 0.0)}


def test_equity_curve_identity(spark):
    """Value is cash plus marked positions, and the opening point repeats the first date."""
    rows = [(1, "A", 10, 10.0, "buy", 0, "2024-01-02"), (1, "A", 5, 12.0, "sell", 1, "2024-01-04")]
    f = spark.createDataFrame(rows, "account long, symbol string, qty long, price double, action string, seq int, day string").withColumn("day", F.to_date("day"))
    o = spark.createDataFrame([(1, 1_000.0)], "account long, cash double")
    c = portfolio.equity_curve(f, portfolio.daily_prices(f), o).orderBy("date", "seq").collect()
    assert [(str(r.date), r.seq, r.value) for r in c] == [("2024-01-02", 0, 1_000.0), ("2024-01-02", 1, 1_000.0), ("2024-01-04", 1, 1_020.0)]
