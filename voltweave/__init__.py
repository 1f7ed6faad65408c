"""Spark-first analytics for electricity-market panels and Bayesian network draws."""
