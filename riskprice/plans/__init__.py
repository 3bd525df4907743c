"""Registered queries (Spark) and their SQL twins used as a correctness oracle."""
