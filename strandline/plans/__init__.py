"""Registered queries: every operator over the driver's tables, with SQL where SQL expresses it."""
