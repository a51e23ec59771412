"""Queries over the test tables, their views and the SQL they are compared with."""
