"""Registered queries: each joins a Spark query with the SQL that must give the same rows."""
