"""Spark-native text similarity, retrieval evaluation and corpus preparation."""
