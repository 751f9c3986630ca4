"""Leakage-safe history features, forecasts and audited evaluation as Spark DataFrame plans."""
