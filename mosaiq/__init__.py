"""Spark-native dataset curation and record fusion."""
