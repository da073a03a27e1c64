"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores.
Every query is run to the end over its whole result (noop sink); nothing is collected.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from barwright import catalog  # noqa: E402
from barwright.session import local_session  # noqa: E402

HEADLINE = [
    "a02_session_summary", "a05_return_pack", "a12a_perf_engine", "a19_fitness", "a22_volatility_pack", "a20_correlation_matrix",
    "w05_rsi", "w07_ema", "w09_macd", "w25_day_signals", "w26_swing_signals", "j02_asof_join", "j09_label_brackets",
    "d03_validate_trades_swing", "d13_ledger", "d15_equity_curve", "k04_technical", "k06_graham", "k12_lynch",
    "v08_screen_valuation", "x02_parameter_sweep",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "barwright-bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/nation.parquet").write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    out = {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}
    print(json.dumps(out), flush=True)


if __name__ == "__main__":
    main()
