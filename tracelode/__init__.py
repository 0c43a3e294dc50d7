"""A PySpark-native engine for evidence retrieval, time-series evaluation and dataset splits."""
