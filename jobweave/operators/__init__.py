"""DataFrame operators of the matching work."""
