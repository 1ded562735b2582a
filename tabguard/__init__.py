"""Spark-native detection of poisoned training data: DataFrame in, DataFrame out."""
