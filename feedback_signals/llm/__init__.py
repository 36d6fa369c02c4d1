"""Operators for preparing training data from web-scale text."""
