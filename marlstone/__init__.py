"""Declarative pipelines, semantic queries, data quality and corpus operators on Spark."""
