"""Bracket outcomes, top-k and as-of joins against brute force; streaming equals batch over several batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barwright.operators import joins, research
from barwright.sources import frames
from barwright.streaming import jobs


def test_stop_comes_before_target_and_gaps_fill_at_open(spark):
    t0 = dt.datetime(2024, 1, 2, 14, 30)
    bars = [("A", t0 + dt.timedelta(minutes=5 * i), *b) for i, b in enumerate([(100., 101., 99., 100.), (90., 120., 89., 95.), (95., 96., 94., 95.)])]
    b = frames.with_session(spark.createDataFrame(bars, "symbol string, ts timestamp_ntz, open double, high double, low double, close double"))
    s = b.filter(F.col("close") == 100.0).select("symbol", "session", "ts", F.lit("long").alias("direction"), F.lit(100.0).alias("entry_price"),
                                                 F.lit(95.0).alias("stop_price"), F.lit(110.0).alias("target_price"))
    r = research.label_brackets(s, b).first()
    assert (r.exit_reason, r.exit_fill) == ("stop", round(90 * 0.9995, 4))
    wide = s.withColumn("stop_price", F.lit(10.0)).withColumn("target_price", F.lit(500.0))
    r = research.label_brackets(wide, b).first()
    assert (r.exit_reason, r.exit_fill) == ("eod", round(95 * 0.9995, 4))


def test_asof_join_matches_brute_force(spark):
    rng = random.Random(11)
    day = dt.date(2020, 1, 1)
    left = [(rng.choice("AB"), day + dt.timedelta(days=rng.randint(0, 700)), i) for i in range(300)]
    right = sorted({(s, day + dt.timedelta(days=rng.randint(0, 700))) for s in "AB" for _ in range(9)})
    right = [(s, d, float(i)) for i, (s, d) in enumerate(right)]
    out = joins.asof_join(spark.createDataFrame(left, "k string, d date, id int"), spark.createDataFrame(right, "k string, d date, v double"), ["k"], "d", ["v"]).collect()
    assert len(out) == 300
    for r in out:
        past = [(d, v) for s, d, v in right if s == r.k and d <= r.d]
        assert r.v == (max(past)[1] if past else None)


def test_price_asof_drops_incomplete_dates(spark):
    d = [dt.date(2024, 1, i) for i in range(1, 6)]
    bars = spark.createDataFrame([("A", d[0], 1.0), ("A", d[1], 2.0), ("B", d[0], 5.0), ("B", d[3], 6.0)], "symbol string, ts date, close double")
    dates = spark.createDataFrame([(x,) for x in d], "date date")
    got = sorted((str(r.date), r.symbol, r.price) for r in joins.price_asof_day(dates, bars).collect())
    assert got == [("2024-01-01", "A", 1.0), ("2024-01-01", "B", 5.0), ("2024-01-02", "A", 2.0), ("2024-01-02", "B", 5.0)]


def test_stream_bars_over_many_batches_equal_batch(spark, sf, tmp_path):
    src = str(tmp_path / "ticks")
    t = frames.ticks(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "ts", "symbol", "price", "size")
    t.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(src)
    stream = jobs.stream_ticks(spark, src, t.schema, per_trigger=4)
    got = jobs.drain(jobs.stream_bars(stream), spark, "t-bars")
    want = t.groupBy("symbol", F.window("ts", "5 minutes").alias("w")).agg(F.sum("size").alias("volume"))
    want = want.filter(F.col("w.end") <= F.expr("timestamp'2024-01-30 12:00:00'")).select("symbol", F.col("w.start").alias("ts"), "volume")
    got = got.filter("ts < timestamp'2024-01-30 11:55:01'").select("symbol", "ts", "volume")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_sweep_keeps_the_best_that_holds(spark):
    def scored(*rows):
        return spark.createDataFrame([(v, s, f) for v, i, o in rows for s, f in (("in", i), ("out", o)) if f is not None], "variant string, side string, fitness double")

    r = research.keep_rule(scored(("x", 5.0, 1.0), ("y", 9.0, -9.0))).first()
    assert (r.variant, r.kept) == ("y", False)
    good = scored(("x", 5.0, 5.0), ("y", 9.0, 9.0))
    assert research.keep_rule(good).first().kept and not research.keep_rule(good, incumbent=9.5).first().kept
    assert not research.keep_rule(scored(("x", 5.0, None))).first().kept
    assert research.keep_rule(scored(("x", None, 5.0))).count() == 0


def test_asof_join_over_a_dense_key(spark):
    """100,000 right rows of one key in one month, ties of days, null keys; blocks by day or by month give the same."""
    rng = random.Random(2)
    t0 = dt.datetime(2024, 3, 1)
    right = [("A", t0 + dt.timedelta(seconds=i * 20), i) for i in range(100_000)] + [("B", t0 + dt.timedelta(days=40), -1), (None, t0, -2)]
    left = [(rng.choice("AB"), t0 + dt.timedelta(seconds=rng.randint(-10**5, 6 * 10**6)), i) for i in range(3_000)] + [(None, t0, -1), ("A", None, -2)]
    l, r = spark.createDataFrame(left, "k string, t timestamp, id int"), spark.createDataFrame(right, "k string, t timestamp, v int")

    def want(k, t):
        if k == "A" and t is not None and t >= t0:
            return min(int((t - t0).total_seconds() // 20), 99_999)
        return -1 if k == "B" and t >= t0 + dt.timedelta(days=40) else None
    for block in ("day", "month"):
        out = joins.asof_join(l, r, ["k"], "t", ["v"], block).collect()
        assert len(out) == len(left) and all(x.v == want(x.k, x.t) for x in out)


FADE = """
from dataclasses import dataclass

@dataclass
class Signal:
    ts: object
    direction: str
    confidence: float
    entry_price: float
    stop_price: float
    target_price: float

def generate_signals(bars, context):
    return [Signal(t, {side}, 70, c, c * 0.9, c * 1.1) for t, c in zip(bars["ts"], bars["close"]) if c > context["over"]]
"""


def test_strategy_from_a_file(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 2, 15)
    bars = frames.with_session(spark.createDataFrame([("A", t0, 10.0), ("A", t0 + dt.timedelta(minutes=5), 30.0), ("B", t0, 20.0)], "symbol string, ts timestamp_ntz, close double"))
    path = tmp_path / "fade.py"
    path.write_text(FADE.format(side="'long'"))
    run = research.load_strategy(spark, str(path), {"over": 15}, "fade")
    got = sorted((r.symbol, r.entry_price, r.direction) for r in research.run_strategy("fade", bars).collect())
    assert got == [("A", 30.0, "long"), ("B", 20.0, "long")] and run(bars.where("close < 15")).count() == 0
    research.register_table_function(spark, "fade_signals", run.generate, run.origin)
    rows = spark.sql("SELECT symbol, entry_price FROM fade_signals(TABLE({b}) PARTITION BY (symbol, session) ORDER BY ts)", b=bars).collect()
    assert sorted(tuple(r) for r in rows) == [("A", 30.0), ("B", 20.0)]
    # new text under the same name is a new strategy
    path.write_text(FADE.format(side="'short'"))
    assert {r.direction for r in research.load_strategy(spark, str(path), {"over": 15})(bars).collect()} == {"short"}


def test_strategy_contract(spark, tmp_path):
    bars = frames.with_session(spark.createDataFrame([("A", dt.datetime(2024, 1, 2, 15), 10.0)], "symbol string, ts timestamp_ntz, close double"))
    cases = {"x = 1": "no function generate_signals", FADE.format(side="'up'"): "neither long nor short", FADE.replace("c * 1.1", "None").format(side="'long'"): "target_price must be numbers",
             "def generate_signals(bars, context):\n    return [{'ts': 1}]": "signals lack direction"}
    for i, (text, said) in enumerate(cases.items()):
        path = tmp_path / f"bad{i}.py"
        path.write_text(text)
        with pytest.raises(Exception, match=said):
            research.load_strategy(spark, str(path), {"over": 1})(bars).collect()


def test_buckets_first_match_wins(spark):
    e = spark.createDataFrame([("Tune MACD and VWAP", True), ("widen vwap band", False), ("unknown", True), ("something else", True)], "hypothesis string, kept boolean")
    got = {r.bucket: (r.tried, r.kept) for r in research.hypothesis_frequency(e).collect()}
    assert got == {"MACD parameters": (1, 1), "VWAP bands": (1, 0), "(other)": (1, 1)}


def test_python_strategy_plugs_in(spark, sf):
    bars = frames.bars5(spark, sf)

    def last_bar(pdf):
        p = pdf.tail(1)
        return p.assign(direction="long", confidence=50.0, entry_price=p.close, stop_price=p.close * 0.9, target_price=p.close * 1.1)[
            ["symbol", "session", "ts", "direction", "confidence", "entry_price", "stop_price", "target_price"]]

    research.STRATEGIES["last_bar"] = research.python_strategy(last_bar)
    assert research.run_strategy("last_bar", bars).count() == bars.select("symbol", "session").distinct().count()
