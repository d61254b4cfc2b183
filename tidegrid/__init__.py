"""Spark-native preparation, feature, backtest and diagnosis library for keyed time series."""
