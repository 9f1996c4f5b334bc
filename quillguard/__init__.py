"""A Spark-native engine for finding, classifying and protecting sensitive data."""
