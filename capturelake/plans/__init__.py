"""Registered queries: each family pairs Spark plans with equivalent SQL."""
