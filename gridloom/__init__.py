"""A Spark-native analytics library for gridded panels and training-data text."""
