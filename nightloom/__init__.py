"""Overnight physiological time series, as Spark jobs."""
