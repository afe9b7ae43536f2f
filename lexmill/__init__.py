"""Labelled multilingual text on Spark: cleaning, splits, features, scoring and metrics.

Every operator takes and returns DataFrames or Columns; nothing here starts a session.
"""
