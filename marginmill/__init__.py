"""Retail promotion and profitability analytics as Spark DataFrame plans."""
