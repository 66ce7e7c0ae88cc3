"""Tamarack: a PySpark-native recommendation and training-data analytics engine."""
