"""Column functions on text, dates, numbers and identifiers."""
