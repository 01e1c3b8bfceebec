"""Trace analytics on Spark: execution logs, control-flow graphs and block sets as tables."""

__version__ = "0.1.0"
