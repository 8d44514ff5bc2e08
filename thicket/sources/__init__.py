"""Datasets, model files, model conversion and generators."""
