"""Spark-native analytics for evidence-first text analysis and corpus preparation."""
