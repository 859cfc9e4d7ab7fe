"""operators of the tracking engine."""
