"""Puts the repository's top on the import path of the tests."""
