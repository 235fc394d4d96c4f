"""PySpark-native tabular, time-series and corpus analytics."""
