"""Listening-history analytics as composable Spark DataFrame operators."""
