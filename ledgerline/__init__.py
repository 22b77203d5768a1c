"""Reusable DataFrame operators and ready-made analytical queries on Apache Spark."""
