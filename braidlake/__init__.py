"""PySpark-native analytics over weighted-ensemble trajectory data."""
