"""Registered queries over the tables, each with an independent SQL statement where one exists."""
