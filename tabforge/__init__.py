"""Tabular feature engineering and ensemble modelling on Spark DataFrames."""
