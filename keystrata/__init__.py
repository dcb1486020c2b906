"""Keystrata: ordered last-write-wins key/value analytics on Spark."""
