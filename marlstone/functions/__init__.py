"""Column functions: numbers, dates, texts."""
