"""Spark-native curation engine for feature-annotated, time-stamped records and text corpora."""
