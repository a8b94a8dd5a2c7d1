"""Readers and writers for raw station files, prepared tables, forecasts and run records."""
