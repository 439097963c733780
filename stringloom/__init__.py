"""A PySpark-native engine for suffix indexes over collections of strings."""
