"""Spark-native dataset splitting, scoring and submission-integrity engine."""

__version__ = "0.1.0"
