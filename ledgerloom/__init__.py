"""Ledgerloom: Spark operators for configuration-style records and their logs.

Every operator takes DataFrames and returns DataFrames; nothing here creates a
session, collects rows or runs Python on executors.
"""
