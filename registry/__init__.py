"""Queries run by the driver, each with its SQL twin where SQL can say it."""
