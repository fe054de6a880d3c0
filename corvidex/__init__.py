"""corvidex: a PySpark-native analytics engine for knowledge, event and session data."""
