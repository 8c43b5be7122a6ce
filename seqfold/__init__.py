"""Spark-native analytics over ordered categorical sequences grouped by entity."""
