"""Registered queries over the driver's tables, each with its SQL where one exists."""
