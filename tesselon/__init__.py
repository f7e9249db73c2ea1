"""Spark-native document retrieval, analytics and corpus preparation."""
