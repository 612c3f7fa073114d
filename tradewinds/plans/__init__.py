"""Layered plans: staging, star schema, analysis, quality suite, full pipeline."""
