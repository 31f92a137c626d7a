"""Column functions: time, text, lists, clinical strings and vectors."""
