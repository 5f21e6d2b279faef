"""Tidewater: incremental three-way reconciliation of mailbox metadata as Spark DataFrames."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
