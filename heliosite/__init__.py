"""Spark-native site screening: identity, tiling, rollups and review queues as DataFrame plans."""
