"""Column functions: numbers, sessions, losses."""
