"""Spark-native table replication: capture, chunk, stage, load, merge and report."""
