"""Label maps between sentiment, direction and signal (fixed values)."""

from pyspark.sql import functions as F

from barwright.functions.numeric import col


def map_sentiment(c):
    return F.when(col(c) == "negative", "bearish").when(col(c) == "positive", "bullish").otherwise("neutral")


def map_direction(c):
    return F.when(col(c) == "long", "bullish").when(col(c) == "short", "bearish").otherwise("neutral")


def signal_value(c):
    return F.when(col(c) == "bullish", 1).when(col(c) == "bearish", -1).otherwise(0)
