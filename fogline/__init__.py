"""Spark-native analytics over uncertain, edge-labelled graphs."""
