"""Spark-native page reading and document analytics."""
