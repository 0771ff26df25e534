"""Quire: a Spark-native engine to curate and evaluate text-recognition datasets."""
