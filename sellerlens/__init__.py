"""Marketplace seller analytics as composable Spark DataFrame operators."""
