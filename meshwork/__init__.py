"""Spark-native graph, similarity and SQL analytics over DataFrames."""
