"""Typed expressions over Spark columns: operators, functions and aggregates."""
