"""Spark-native corpus analytics: DataFrame in, DataFrame out."""
