"""Spark-native null-calibrated inference on grouped, blocked, repeated-measures data."""
