"""Query plans: skew-safe scans, derived inputs over the driver tables, the query catalogue."""
