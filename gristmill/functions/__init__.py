"""Column expressions: text, dates, arrays."""
