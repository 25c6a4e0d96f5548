"""Composed jobs and the catalogue of named queries with their SQL oracles."""
