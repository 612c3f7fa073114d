"""DataFrame-level operators used by the plans."""
