"""Spark-native analytics for question-and-answer corpora."""
