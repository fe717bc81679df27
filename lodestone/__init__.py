"""Spark-native evidence retrieval, version comparison and corpus quality engine."""
