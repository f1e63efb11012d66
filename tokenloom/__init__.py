"""Spark-native accounting of token usage, reconciled from session logs and columnar tables."""
