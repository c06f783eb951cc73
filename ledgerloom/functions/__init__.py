"""Column functions: text, dates, amounts, statistics."""
