"""Operators over an archive's relations: ranges, graph, search, views, libraries."""
