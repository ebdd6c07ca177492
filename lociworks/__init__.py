"""A PySpark-native analytics engine for per-observation variant tables."""
