"""Gradient boosting and model analytics as Spark dataflows."""
