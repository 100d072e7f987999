"""Tessella: a Spark-native engine for code-structure analytics and data processing at scale."""

from tessella.session import build_session

__all__ = ["build_session"]
__version__ = "0.1.0"
