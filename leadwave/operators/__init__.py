"""Operators on recordings, electrodes and band power, each from DataFrames to a DataFrame."""
