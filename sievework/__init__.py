"""Spark-native analytics for algorithm-selection experiments and text corpora."""
