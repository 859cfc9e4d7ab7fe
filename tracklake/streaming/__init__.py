"""streaming of the tracking engine."""
