"""Marketplace analytics on Spark: cleaning, star schema, KPIs, cohorts and data-quality checks."""

__version__ = "0.1.0"
