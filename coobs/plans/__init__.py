"""Plan shapes shared by the operators: skew-safe joins, ranks, quantiles, moments."""
