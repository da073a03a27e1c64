"""Registered streaming jobs, drained over the given event files."""

from pyspark.sql import functions as F

from barwright.catalog.registry import ORACLES, query, r, rcols, tidy
from barwright.catalog.sqlframes import TICKS
from barwright.operators import risk
from barwright.sources import frames
from barwright.streaming import jobs, monitors
from barwright.streaming.monitors import NEAR

# windows close once the watermark (newest event less ten minutes) has passed their end
CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM ticks)"


def raw(spark, sf, name):
    # a file stream wants a folder or a pattern
    return jobs.stream_ticks(spark, f"{sf.rstrip('/')}/{name}.parque[t]", frames.table(spark, sf, name).schema)


def instant(c):
    """A zone-less time read as UTC: watermarks need an instant."""
    return F.expr(f"timestamp_micros(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {c}))")


def naive(c):
    return F.expr(f"timestampadd(MICROSECOND, unix_micros({c}), timestamp_ntz'1970-01-01 00:00:00')").alias(c)


def ticks(spark, sf, ts=None):
    return raw(spark, sf, "events").select(
        "event_id", (instant("ts") if ts is None else F.col("ts")).alias("ts"), F.col("event_type").alias("symbol"), (100 + F.col("value") / 120).alias("price"),
        F.regexp_extract("props", r"(\d+)", 1).cast("long").alias("size"))


@query("r01_stream_bars", f"""WITH {TICKS}, b AS (SELECT *, time_bucket(INTERVAL '5 minutes', ts) AS bar FROM ticks) SELECT symbol, bar AS ts, {r('arg_min(price, (b.ts, event_id))')} AS open, {r('max(price)')} AS high,
  {r('min(price)')} AS low, {r('arg_max(price, (b.ts, event_id))')} AS close, CAST(sum(size) AS BIGINT) AS volume FROM b GROUP BY symbol, bar HAVING bar + INTERVAL 5 MINUTE <= {CLOSED}""")
def _(spark, sf):
    return tidy(jobs.drain(jobs.stream_bars(ticks(spark, sf)), spark, "r01").withColumn("ts", naive("ts")))


@query("r02_stream_last30", f"""WITH {TICKS}, x AS (SELECT *, time_bucket(INTERVAL '5 minutes', ts) - INTERVAL 5 MINUTE * i AS start FROM ticks, range(6) t(i))
  SELECT symbol, start, start + INTERVAL 30 MINUTE AS "end", {r('max(price)')} AS high, {r('min(price)')} AS low, {r('arg_max(price, (ts, event_id))')} AS close, count(*) AS ticks FROM x GROUP BY symbol, start HAVING start + INTERVAL 30 MINUTE <= {CLOSED}""")
def _(spark, sf):
    return tidy(jobs.drain(jobs.stream_last30(ticks(spark, sf)), spark, "r02").withColumn("start", naive("start")).withColumn("end", naive("`end`")))


@query("r03_stream_session", f"""WITH {TICKS} SELECT symbol, CAST(ts AS DATE) AS session, {r('sum(price * size) / nullif(sum(size), 0)')} AS vwap, {r('max(price)')} AS high, {r('min(price)')} AS low, CAST(sum(size) AS BIGINT) AS volume FROM ticks GROUP BY 1, 2""")
def _(spark, sf):
    rows = jobs.drain(jobs.stream_session(ticks(spark, sf)), spark, "r03", "update")
    keys = ["symbol", "session"]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct("vwap", "high", "low", "volume"), "batch").alias("s")).select(*keys, "s.*")
    return tidy(last)


def landed(spark, sf, name):
    """The ticks as files that land in the order of time, one slice a batch."""
    src = frames.table(spark, sf, "events")
    return jobs.stream_ticks(spark, jobs.land_by_time(src.select("*", instant("ts").alias("_order")), spark, name, "_order").rstrip("/"), src.schema, 4)


def landed_ticks(spark, sf, name):
    return landed(spark, sf, name).select(
        "event_id", instant("ts").alias("ts"), F.col("event_type").alias("symbol"), (100 + F.col("value") / 120).alias("price"), "user_id")


def books(spark, sf):
    """Positions of ten books: a book enters a symbol with its first tick there."""
    ev = frames.table(spark, sf, "events").select((F.col("user_id") % 10).alias("account"), F.col("event_type").alias("symbol"), "event_id", "ts", (100 + F.col("value") / 120).alias("price"))
    first = ev.groupBy("account", "symbol").agg(F.min_by(F.struct("price", "ts"), F.struct("ts", "event_id")).alias("e"))
    return first.select("account", "symbol", F.col("e.price").alias("entry"), instant("e.ts").alias("since"))


STOPS = {"stop_loss_pct": 0.05, "trailing_stop_pct": 0.08, "flatten_minute": 945}
MINUTES = f"""{TICKS.replace("SELECT event_id, ts,", "SELECT event_id, ts, user_id,")}, mark AS (SELECT max(ts) - INTERVAL 10 MINUTE AS wm FROM ticks),
  mins AS (SELECT symbol, time_bucket(INTERVAL 1 MINUTE, ts) AS bar, max(price) AS high, arg_max(price, (ts, event_id)) AS close, arg_min(price, (ts, event_id)) AS first, min(price) AS least
    FROM ticks GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 MINUTE, any_value(ts)) + INTERVAL 1 MINUTE <= (SELECT wm FROM mark))"""


def stops_sql(lim):
    """Per position: minutes from its entry to its flatten moment, exits and first warnings among them."""
    stop, trail, minute = lim["stop_loss_pct"], lim["trailing_stop_pct"], lim["flatten_minute"]
    cand = f"date_trunc('day', since - INTERVAL 4 HOUR) + INTERVAL 4 HOUR + INTERVAL {minute} MINUTE"
    return f"""WITH {MINUTES}, pos AS (SELECT user_id % 10 AS account, symbol, arg_min(price, (ts, event_id)) AS entry, min(ts) AS since FROM ticks GROUP BY 1, 2),
  p AS (SELECT *, CASE WHEN {cand} >= since THEN {cand} ELSE {cand} + INTERVAL 1 DAY END AS fm FROM pos WHERE entry > 0),
  b AS (SELECT p.*, bar, close, max(high) OVER w AS high, CAST(bar - INTERVAL 4 HOUR AS DATE) AS day FROM p JOIN mins m ON m.symbol = p.symbol AND bar >= date_trunc('millisecond', since) AND bar < fm
    WINDOW w AS (PARTITION BY account, p.symbol, CAST(bar - INTERVAL 4 HOUR AS DATE) ORDER BY bar)),
  k AS (SELECT *, (close - entry) / entry AS fall, (close - high) / high AS fell, CASE WHEN (close - entry) / entry <= -{stop} THEN 'hard_stop' WHEN (close - high) / high <= -{trail} THEN 'trailing_stop' END AS exit FROM b),
  o AS (SELECT k.*, min(bar) FILTER (exit IS NOT NULL) OVER (PARTITION BY account, symbol) AS gone FROM k),
  n AS (SELECT account, symbol, min(bar) AS ts, 'near_hard_stop' AS kind, arg_min(close, bar) AS price, arg_min(high, bar) AS high, any_value(entry) AS entry FROM o WHERE fall <= -{NEAR * stop} AND (gone IS NULL OR bar < gone) GROUP BY account, symbol, day
    UNION ALL SELECT account, symbol, min(bar), 'near_trailing_stop', arg_min(close, bar), arg_min(high, bar), any_value(entry) FROM o WHERE fell <= -{NEAR * trail} AND (gone IS NULL OR bar < gone) GROUP BY account, symbol, day
    UNION ALL SELECT account, symbol, bar, exit, close, high, entry FROM o WHERE bar = gone
    UNION ALL SELECT account, symbol, any_value(fm), 'eod_flatten', (SELECT arg_max(close, bar) FROM o WHERE o.account = p.account AND o.symbol = p.symbol), (SELECT arg_max(high, bar) FROM o WHERE o.account = p.account AND o.symbol = p.symbol), any_value(entry)
      FROM p WHERE fm <= (SELECT wm FROM mark) AND NOT EXISTS (SELECT 1 FROM o WHERE o.account = p.account AND o.symbol = p.symbol AND gone IS NOT NULL) GROUP BY account, symbol)
  SELECT account, symbol, ts, kind, {rcols('price high entry')} FROM n"""


@query("r04_stream_stops", stops_sql(STOPS))
def _(spark, sf):
    """Four batches; positions of ten books, flattened at a quarter to four."""
    bars = monitors.minute_bars(landed_ticks(spark, sf, "r04-in"))
    s = jobs.drain(monitors.stream_stops(bars, books(spark, sf), "day", STOPS), spark, "r04", keyed=True)
    return tidy(s.withColumn("ts", naive("ts")))


@query("r05_stream_breaker", f"""WITH {MINUTES}, d AS (SELECT symbol AS account, CAST(bar AS DATE) AS day, bar AS ts, least AS equity, first_value(first) OVER (PARTITION BY symbol, CAST(bar AS DATE) ORDER BY bar) AS s FROM mins),
  k AS (SELECT *, row_number() OVER (PARTITION BY account, day ORDER BY ts) AS rn FROM d WHERE (equity - s) / s <= -0.01) SELECT account, day, ts, {r('equity')} AS equity, {r('(equity - s) / s')} AS loss_pct FROM k WHERE rn = 1""")
def _(spark, sf):
    eq = landed_ticks(spark, sf, "r05-in").select("event_id", "ts", F.col("symbol").alias("account"), F.col("price").alias("equity"))
    s = jobs.drain(monitors.stream_breaker(monitors.minute_equity(eq), limit=0.01), spark, "r05", keyed=True)
    return tidy(s.select("account", F.to_date(F.to_utc_timestamp("day", F.current_timezone())).alias("day"), naive("ts"), "equity", "loss_pct"))


@query("r06_stream_journal", "SELECT DISTINCT o_orderkey AS order_id, o_orderdate AS timestamp FROM orders")
def _(spark, sf):
    o = raw(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), instant("o_orderdate").alias("timestamp"))
    twice = o.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    return jobs.drain(jobs.stream_journal(twice), spark, "r06").withColumn("timestamp", naive("timestamp"))


@query("r07_stream_alerts", f"""{ORACLES['d07_concentration_alerts']} UNION ALL SELECT account, type, NULL, value, threshold FROM ({ORACLES['d08_cash_alerts']})""")
def _(spark, sf):
    """Positions arrive account by account in several files; each micro-batch runs the concentration and cash checks."""
    landed, out, ck = (jobs.scratch(spark, n) for n in ("r07-in", "r07", "r07-ck"))
    frames.positions(spark, sf).repartition(4, "account").write.parquet(landed)
    acc = frames.accounts(spark, sf)
    of = lambda batch: acc.join(batch.select("account").distinct(), "account", "left_semi")
    checks = [lambda b: risk.concentration_alerts(b, of(b), spark, "swing"), lambda b: risk.cash_alerts(of(b), "swing")]
    positions = jobs.stream_ticks(spark, landed, spark.read.parquet(landed).schema, 1)
    jobs.stream_alerts(positions, out, checks, ck).awaitTermination()
    found = spark.read.schema("account long, type string, subject string, value double, threshold double").json(out)
    return tidy(found.select("account", "type", "subject", "value", "threshold"), 3)
