"""Spark-native statistics of gridded fields, series and feature matrices."""
