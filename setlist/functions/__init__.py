"""Column functions: dates, names, text and URLs."""
