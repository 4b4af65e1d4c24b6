"""Composed pipelines and the queries the entry module registers."""
