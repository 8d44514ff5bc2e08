"""Binning, histograms, splits, sampling, inference, linear leaves and attribution."""
