"""Spark-first engine for code search, code graphs and corpus preparation."""
