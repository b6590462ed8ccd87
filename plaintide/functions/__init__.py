"""Column functions: scoring, text, redaction, dates."""
