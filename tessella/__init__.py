"""Spark-native tabular analysis: profiling, features, guarded queries, text guards, vector reuse."""
