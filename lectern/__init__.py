"""Spark-native discourse analytics: typed speech turns, lexicon scoring, rate tables."""

__version__ = "0.1.0"
