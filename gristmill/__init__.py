"""PySpark-native analytics for documents, change logs and event data."""
