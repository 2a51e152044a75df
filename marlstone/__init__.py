"""Spark-native text retrieval, forecast evaluation and corpus preparation."""
