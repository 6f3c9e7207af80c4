"""Operators for preparing large text collections, independent of the rest of the package."""
