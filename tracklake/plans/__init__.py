"""plans of the tracking engine."""
