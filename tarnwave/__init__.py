"""Spark-native analytics over long tables of ordered samples."""
