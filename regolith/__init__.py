"""Spark-native analytics over a content-addressed registry of data elements."""
