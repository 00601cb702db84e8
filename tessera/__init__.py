"""A Spark-native analytics engine."""
