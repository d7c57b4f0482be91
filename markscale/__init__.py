"""Spark jobs for evaluating question-answering models over JSON-lines data."""

from markscale.session import configure, materialise

__all__ = ["configure", "materialise"]
