"""Spark-native detection, pseudonymisation and evaluation of personal data."""

__version__ = "0.1.0"
