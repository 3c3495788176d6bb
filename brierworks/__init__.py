"""Spark-native operators for verifying, pricing and sizing probabilistic forecasts."""
