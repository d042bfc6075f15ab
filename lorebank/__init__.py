"""Fact and question analytics on PySpark."""
