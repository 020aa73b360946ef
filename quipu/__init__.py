"""Fiscal and price analytics on PySpark."""
