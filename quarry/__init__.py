"""Spark-native analytics over document corpora: sources, cleaning, statistics, vectors, search, reports."""
