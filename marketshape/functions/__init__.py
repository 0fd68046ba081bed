"""Column-in, Column-out rules."""
