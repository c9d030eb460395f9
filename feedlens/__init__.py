"""Engagement analytics on PySpark."""
