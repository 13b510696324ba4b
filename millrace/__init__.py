"""Spark-native record ingestion, traffic simulation and text-corpus operators."""
