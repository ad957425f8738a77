"""Column helpers, fixed word lists and distributed ranking."""
