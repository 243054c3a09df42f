"""Lodestone: a Spark-native engine that curates and selects instruction-tuning data."""
