"""PySpark-native analytics for sports-competition results."""
