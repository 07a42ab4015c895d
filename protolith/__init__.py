"""Spark-native engine for protocol-table analytics."""
