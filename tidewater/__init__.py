"""Observability analytics on Spark: logs, spans, metrics and events at cluster scale."""

__version__ = "0.1.0"
