"""Operators on signals, intervals and events: DataFrame in, DataFrame out."""
