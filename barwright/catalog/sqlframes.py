"""The canonical frames as SQL common table expressions, for the oracles."""

BARS = """bars AS (
  SELECT c_mktsegment AS symbol, CAST(o_orderdate AS DATE) AS ts,
         arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
         min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""

TICKS = """ticks AS (
  SELECT event_id, ts, event_type AS symbol, value, 100 + value / 120 AS price,
         CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS size FROM events)"""

BARS5 = TICKS + """, bars5 AS (
  SELECT symbol, bar AS ts, open, high, low, close, volume,
         CAST(bar - INTERVAL 4 HOUR AS DATE) AS session,
         hour(bar - INTERVAL 4 HOUR) * 60 + minute(bar - INTERVAL 4 HOUR) AS et_minute
  FROM (SELECT symbol, time_bucket(INTERVAL '5 minutes', ts) AS bar,
               arg_min(price, (ts, event_id)) AS open, max(price) AS high, min(price) AS low,
               arg_max(price, (ts, event_id)) AS close, CAST(sum(size) AS BIGINT) AS volume
        FROM ticks GROUP BY 1, 2))"""

from barwright.sources.frames import TICKERS

TICKER_LIST = "[" + ", ".join(f"'{t}'" for t in TICKERS) + "]"


def ticker(key):
    return f"{TICKER_LIST}[CAST({key} % {len(TICKERS)} + 1 AS INTEGER)]"


FILLS = f"""fills AS (
  SELECT l_suppkey AS account, {ticker('l_partkey')} AS symbol,
         CAST(l_quantity AS BIGINT) AS qty, l_extendedprice / (l_quantity + 0.37) AS price,
         CASE l_returnflag || l_linestatus WHEN 'NO' THEN 'buy' WHEN 'NF' THEN 'buy' WHEN 'RO' THEN 'sell'
              WHEN 'AO' THEN 'short' WHEN 'AF' THEN 'cover' ELSE 'hold' END AS action,
         CAST(l_shipdate AS DATE) AS day, l_shipdate, l_orderkey, l_linenumber, l_partkey
  FROM lineitem)"""

MARKS = """marks AS (
  SELECT symbol, arg_max(price, (l_shipdate, l_orderkey, l_linenumber, l_partkey, account)) AS price
  FROM fills GROUP BY 1)"""

POSITIONS = FILLS + ", " + MARKS + """, positions AS (
  SELECT n.account, n.symbol, qty, avg_entry_price, m.price AS current_price, qty * m.price AS market_value,
         (m.price - avg_entry_price) * qty AS unrealized_pl,
         (m.price - avg_entry_price) * sign(qty) / nullif(avg_entry_price, 0) AS unrealized_plpc
  FROM (SELECT account, symbol,
          CAST(sum(CASE WHEN action IN ('buy', 'cover') THEN qty WHEN action IN ('sell', 'short') THEN -qty ELSE 0 END) AS BIGINT) AS qty,
          sum(CASE WHEN action = 'buy' THEN qty * price END) / sum(CASE WHEN action = 'buy' THEN qty END) AS avg_entry_price
        FROM fills GROUP BY 1, 2) n JOIN marks m USING (symbol))"""

ACCOUNTS = POSITIONS + """, accounts AS (
  SELECT s_suppkey AS account, abs(s_acctbal) * 1000 AS cash, abs(s_acctbal) * 1000 + coalesce(held, 0) AS equity,
         (abs(s_acctbal) * 1000 + coalesce(held, 0)) * (1 + (s_nationkey - 12) / 200) AS last_equity
  FROM supplier LEFT JOIN (SELECT account, sum(market_value) AS held FROM positions GROUP BY 1) ON account = s_suppkey)"""

SNAPSHOTS = """snapshots AS (
  SELECT *, equity * (day(date) % 5 + 1) / 10 AS cash FROM (
  SELECT account, date, 1e6 * exp(sum((a / 250000 - 1) * 0.01) OVER w) AS equity,
         400 * exp(sum((s / 250000 - 1) * 0.01) OVER w) AS spy_price,
         300 * exp(sum((q / 300000 - 1) * 0.01) OVER w) AS qqq_price, position_count
  FROM (SELECT c_mktsegment AS account, CAST(o_orderdate AS DATE) AS date,
          avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 500000 - o_totalprice END) AS a,
          avg(o_totalprice) AS s, max(o_totalprice) AS q, count(*) AS position_count
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY account ORDER BY date)))"""

JOURNAL = f"""journal AS (
  SELECT o_orderdate AS timestamp, CASE WHEN o_custkey % 2 = 0 THEN 'swing' ELSE 'day' END AS mode,
         {ticker('o_custkey')} AS ticker, action, o_orderkey % 100 AS qty,
         CASE o_orderstatus WHEN 'F' THEN 'executed' WHEN 'O' THEN 'blocked' ELSE 'failed' END AS status,
         CASE WHEN action IN ('sell', 'cover') THEN o_totalprice - 250000 END AS pnl, o_orderkey AS order_id
  FROM (SELECT *, CASE left(o_orderpriority, 1) WHEN '1' THEN 'buy' WHEN '2' THEN 'sell' WHEN '3' THEN 'short'
                  WHEN '4' THEN 'cover' ELSE 'hold' END AS action FROM orders))"""

SIGNALS = """signals AS (
  SELECT CAST(ts AS DATE) AS date, 'analyst' || (user_id % 10) AS analyst, event_type AS symbol,
         CASE WHEN value > 60 THEN 'bullish' WHEN value < 20 THEN 'bearish' ELSE 'neutral' END AS signal,
         CASE WHEN CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) > 4 THEN CAST(regexp_extract(props, '(\\d+)', 1) AS DOUBLE) END AS confidence, event_id
  FROM events)"""

NEWS = """news AS (
  SELECT doc_id, source AS symbol, text AS title,
         CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' WHEN quality = 0 THEN 'neutral' END AS sentiment,
         CASE WHEN quality IS NOT NULL THEN CAST(doc_id % 100 AS DOUBLE) END AS model_confidence,
         DATE '1995-01-01' + CAST(doc_id % 2500 AS INTEGER) AS date
  FROM documents LEFT JOIN labels USING (doc_id))"""

EXPERIMENTS = """experiments AS (
  SELECT doc_id AS experiment_id, source AS run_id, text AS hypothesis, (n_chars % 997) / 10 - 50 AS fitness_score,
         coalesce(quality = 1, false) AS kept, CASE WHEN lang = 'en' THEN 'day' ELSE 'swing' END AS mode
  FROM documents LEFT JOIN labels USING (doc_id))"""

RUNS = EXPERIMENTS + """, runs AS (
  SELECT *, best_fitness - baseline_fitness AS improvement FROM (
  SELECT run_id, mode, min(experiment_id) AS started, count(*) AS total_experiments,
         count(*) FILTER (kept) AS keep_count, arg_min(fitness_score, experiment_id) AS baseline_fitness,
         max(fitness_score) AS best_fitness FROM experiments GROUP BY 1, 2))"""


def _panel():
    from barwright.sources.frames import PANEL_STAGES
    out = """p0 AS (SELECT symbol, report_period, g, rr, CAST(regexp_extract(symbol, '(\\d+)', 1) AS DOUBLE) AS b,
        CAST((year(report_period) - 1995) * 4 + quarter(report_period) - 1 AS DOUBLE) AS t
      FROM (SELECT p_brand AS symbol, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS report_period, round(sum(l_extendedprice), 2) AS g,
              round(coalesce(sum(l_extendedprice) FILTER (l_returnflag = 'R'), 0), 2) AS rr FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2))"""
    for i, stage in enumerate(PANEL_STAGES):
        name = "panel" if i == len(PANEL_STAGES) - 1 else f"p{i + 1}"
        cols = ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in stage.items())
        out += f", {name} AS (SELECT *, {cols} FROM p{i})"
    return out


PANEL = _panel()


def profile(n, name="prof", source="panel"):
    """Latest n periods per symbol: per item the newest value and the newest-first known values."""
    from barwright.sources.frames import PANEL_ITEMS
    cols = ", ".join(f"list({c} ORDER BY report_period DESC)[1] AS {c}_0, list({c} ORDER BY report_period DESC) FILTER ({c} IS NOT NULL) AS {c}" for c in PANEL_ITEMS)
    return f"""{name} AS (SELECT symbol, count(*) AS n, {cols} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY report_period DESC) AS rk FROM {source}
      WHERE report_period <= DATE '2001-09-30') WHERE rk <= {n} GROUP BY 1)"""


INSIDER = """insider AS (SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS filing_date,
    l_quantity * CASE l_returnflag WHEN 'R' THEN -1 WHEN 'A' THEN 1 END AS transaction_shares,
    CASE WHEN l_linestatus = 'F' THEN round(l_extendedprice) END AS transaction_value FROM lineitem JOIN part ON l_partkey = p_partkey /*known*/),
  flow AS (SELECT symbol, count(*) FILTER (transaction_shares > 0) AS buys, count(*) FILTER (transaction_shares < 0) AS sells, coalesce(sum(transaction_shares), 0) AS net_shares,
    coalesce(sum(transaction_shares) FILTER (transaction_shares > 0), 0) AS bought, coalesce(-sum(transaction_shares) FILTER (transaction_shares < 0), 0) AS sold,
    coalesce(sum(transaction_value) FILTER (transaction_shares > 0), 0) AS buy_value, coalesce(sum(transaction_value) FILTER (transaction_shares < 0), 0) AS sell_value,
    count(transaction_shares) AS trades FROM insider GROUP BY 1)"""

BRAND_NEWS = NEWS + """, brand_news AS (SELECT * REPLACE ('Brand#' || (CAST(regexp_extract(symbol, '(\\d+)', 1) AS INT) + 1) AS symbol) FROM news /*known*/)"""

AS_OF = "2001-09-30"


def known(text, date, days=None):
    """The frames as known at AS_OF, by a filter inside the first frame; with ``days`` no older than that."""
    since = f" AND {date} >= DATE '{AS_OF}' - {days}" if days else ""
    return text.replace("/*known*/", f"WHERE {date} <= DATE '{AS_OF}'{since}")


INSIDER_AT, INSIDER_YEAR = (known(INSIDER, "CAST(l_shipdate AS DATE)", d) for d in (None, 365))
BRAND_NEWS_AT, BRAND_NEWS_YEAR = (known(BRAND_NEWS, "date", d) for d in (None, 365))

BRAND_BARS = """brand_bars AS (SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS ts, arg_min(px, (l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS open, max(px) AS high, min(px) AS low,
    arg_max(px, (l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS close, count(*) AS volume
  FROM (SELECT *, l_extendedprice / (l_quantity + 0.37) AS px FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1, 2)"""
