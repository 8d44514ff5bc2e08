"""Models applied to streams."""
