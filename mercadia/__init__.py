"""Retail order analytics as Spark DataFrame jobs."""

from mercadia.functions.params import Period
from mercadia.sources.shop import Shop

__all__ = ["Period", "Shop"]
