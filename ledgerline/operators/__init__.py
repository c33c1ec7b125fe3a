"""Part of the filing-analytics engine."""
