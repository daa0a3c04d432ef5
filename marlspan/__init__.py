"""Spark-native analytics for market, macro, fundamentals, calendar and news tables."""
