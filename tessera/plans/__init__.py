"""Queries: operators applied to the tables of a data folder, each with its SQL."""
