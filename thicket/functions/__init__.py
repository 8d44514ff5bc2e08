"""Losses, output transforms and metrics."""
