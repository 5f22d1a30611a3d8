"""qtrail.sources."""
