"""qtrail.plans."""
