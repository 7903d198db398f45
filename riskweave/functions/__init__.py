"""Column expressions: dates, nulls, guarded statistics, quantiles, splits."""
