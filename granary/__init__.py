"""Granary: a PySpark-native retrieval and corpus analytics engine."""
