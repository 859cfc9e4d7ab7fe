"""sources of the tracking engine."""
