"""functions of the tracking engine."""
