"""Spark-native entity linking and panel analytics."""
