"""Ledger-integrity analytics as Spark jobs: every operator is a function of DataFrames."""

__version__ = "0.1.0"
