"""Operators for preparing training text, each with its own module.

Nothing else in the library imports this package.
"""
