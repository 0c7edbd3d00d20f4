"""Volumetric analytics and corpus operators on PySpark."""
