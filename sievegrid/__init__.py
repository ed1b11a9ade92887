"""PySpark-native analytics for group-exposure studies over tabular data."""
