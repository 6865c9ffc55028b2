"""Spark-native time-series matrix estimation: imputation, de-noising, forecasting and synthetic control."""
