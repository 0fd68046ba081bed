"""Queries: operators applied to the tables, each with its SQL where SQL can say it."""
