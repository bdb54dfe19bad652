"""A Spark-native data-quality engine for card transactions."""
