"""Spark-native engine that finds contradictions between factual claims."""
