"""Training loops, estimators and evaluation."""
