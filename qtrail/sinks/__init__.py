"""qtrail.sinks."""
