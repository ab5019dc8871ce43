"""Constella: graph layout analytics and corpus preparation on PySpark."""
