"""A Spark-native engine for panels of investment-algorithm prices."""
