"""Registered queries: each module pairs Spark queries with their oracle SQL."""
