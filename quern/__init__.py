"""Quern: a PySpark-native engine for object-store analytics."""
