"""Logs of runs whose values move between them."""

from pyspark.sql import functions as F

from barwright.catalog import landing, registry


def test_alert_log_of_moving_values(spark, sf, monkeypatch):
    """Values that differ in their last digits when computed again are still one record of two runs (F1)."""
    def alerts(spark, sf):
        return spark.range(5).select(F.col("id").alias("account"), F.lit("A").alias("symbol"), (F.unix_micros(F.current_timestamp()) * 1e-15).alias("plpc"))
    monkeypatch.setattr(landing, "scanner_alerts", alerts)
    assert [(r.account, r.times) for r in registry.QUERIES["s16_append_json"](spark, sf).orderBy("account").collect()] == [(i, 2) for i in range(5)]
