"""Registered queries of the engine and the SQL that states the same result."""
