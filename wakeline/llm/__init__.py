"""Operators on names and texts. Nothing else in the library imports this subpackage."""
