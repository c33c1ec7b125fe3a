"""Column functions: text, dates, decimals and JSON."""
