"""Spark-first analytics for language-data workloads."""
