"""Spark-native analytics over logs of multi-step agent episodes."""
