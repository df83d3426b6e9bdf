"""Tabular, text and time-series preparation, profiling, modelling and scoring on Spark."""

__version__ = "0.1.0"
