"""Spark-native evidence retrieval, question routing and retrieval evaluation."""
