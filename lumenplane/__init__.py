"""Spark-native analytics over multidimensional microscopy data."""
