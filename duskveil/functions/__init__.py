"""Column expressions: text masks, number reading, keyed randomness and dates."""
