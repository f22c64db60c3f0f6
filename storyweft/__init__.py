"""Narrative analytics on Spark: DataFrame operators over dated, sourced texts."""

__version__ = "0.1.0"
