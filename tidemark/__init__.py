"""Spark-native analytics for count series: time axis, features, splits, forecasts, metrics, tests."""
