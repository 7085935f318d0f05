"""Hexweave: shortest-path shortcuts over a hexagonal cell hierarchy, as Spark jobs."""
