"""Queries by name, one or more for each operator, with the SQL that checks them."""
