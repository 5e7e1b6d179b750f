"""Sequence and corpus analytics expressed as Spark jobs."""
