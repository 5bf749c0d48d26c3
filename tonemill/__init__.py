"""tonemill: a PySpark-native engine for text-signal analytics."""
