"""Spark-native document analytics: corpus building, retrieval, evaluation, audits and feeds."""
