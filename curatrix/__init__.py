"""A PySpark-native engine for curating, auditing and evaluating training data."""
