"""Spark-native engine for digitised bilingual manuscripts."""

__all__ = ["session", "tables"]
