"""Spark-native analytics over source-code fingerprints and text collections."""
