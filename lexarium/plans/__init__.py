"""Pipelines, and the catalog of queries with their SQL."""
