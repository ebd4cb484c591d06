"""Spark-native analytics over frame stacks and text corpora."""
