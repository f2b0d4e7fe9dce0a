"""Operators: DataFrame in, DataFrame out; fold, split, model and seed are columns."""
