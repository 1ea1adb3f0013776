"""The driver's API and the catalogue of queries."""
