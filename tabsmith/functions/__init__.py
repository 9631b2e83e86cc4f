"""Column expressions: quoting, cleaning, statistics, keyed randomness, bands."""
