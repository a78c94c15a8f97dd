"""Relational operators over bars, features, trades, runs and event logs."""
