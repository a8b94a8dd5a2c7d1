"""Forecast evaluation and telemetry analytics as Spark DataFrame transformations."""
