"""Registered queries with the SQL that they equal."""
