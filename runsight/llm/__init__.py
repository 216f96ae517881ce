"""Operators for preparing training text, each in a module of its own. Nothing else in the library imports this package."""
