"""Tabular method evaluation as Spark jobs."""
