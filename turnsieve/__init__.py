"""Spark-native analytics for compressed dialogues: selection, probing, scoring, statistics."""

__all__ = ["operators", "sources", "functions", "plans", "streaming"]
