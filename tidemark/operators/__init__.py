"""Operators on series, splits, predictions and models: DataFrame in, DataFrame out."""
