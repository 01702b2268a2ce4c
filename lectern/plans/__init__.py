"""Queries over the given tables, one for each operator, with the SQL that checks them."""
