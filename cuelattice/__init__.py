"""Spark-first analytics over timed text: interval algebra, robust time-series statistics and library reports."""
