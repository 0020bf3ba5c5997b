"""Catalogue analytics and recommendation operators for PySpark."""

__version__ = "0.1.0"
