"""Spark-native template matching on n-d grids, and the data processing around it."""
